"""Queries on the problems of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.paths import canonical_text
from logweave.llm.conversations import conversation_verdicts, conversations, read_entries
from logweave.llm.languages import label_segments, wrong_labels
from logweave.llm.mixing import halfway, mix_sources
from logweave.llm.pii import learn_names, mention_table, sanitised_table, with_forms
from logweave.llm.runs import collapse_runs
from logweave.llm.tokens import count_tokens, encode_column
from logweave.runtime import cut, table

def _call_value():
    """Name and target in one spelling; null without a name or a target."""
    return F.concat(canonical_text(F.col("name")), F.lit("\n"), canonical_text(F.col("target")))


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of calls as one call with its count and duration."""
    calls = table(spark, sf_dir, "tool_calls")
    return collapse_runs(calls, "transcript_id", "seq", _call_value(), "at_s")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = p1_runs(spark, sf_dir).where("n > 1")
    return runs.select(F.col("entity").alias("transcript_id"), "first_seq", "last_seq")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, row_key, field, text)`` of every brief, result and message, each row of the tables once, with their forms."""
    agents = table(spark, sf_dir, "agents").select("agent_id", "brief", "result")
    agents = agents.groupBy("agent_id", F.xxhash64("brief", "result").alias("h")).agg(
        F.first("brief").alias("brief"), F.first("result").alias("result")
    )
    attention = table(spark, sf_dir, "attention").select("attention_id", "message")
    attention = attention.groupBy("attention_id", F.xxhash64("message").alias("h")).agg(
        F.first("message").alias("message")
    )
    wide = agents.select(
        F.lit("agents").alias("src"), F.col("agent_id").alias("row_key"),
        F.inline(F.array(
            F.struct(F.lit("brief").alias("field"), F.col("brief").alias("text")),
            F.struct(F.lit("result").alias("field"), F.col("result").alias("text")),
        )),
    ).unionByName(attention.select(
        F.lit("attention").alias("src"), F.col("attention_id").cast("string").alias("row_key"),
        F.lit("message").alias("field"), F.col("message").alias("text"),
    ))
    return cut(with_forms(wide.where("text is not null"), "text"))


def p2_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    lexicon = learn_names(texts, "text", table(spark, sf_dir, "name_parts"))
    return mention_table(texts, ["src", "row_key", "field"], "text", lexicon)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_mentions(spark, sf_dir).select("src", "row_key", "field", "pii_type", "occurrence")


def p2_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in the place of its mentions."""
    texts = _texts(spark, sf_dir)
    lexicon = learn_names(texts, "text", table(spark, sf_dir, "name_parts"))
    return sanitised_table(texts, ["src", "row_key", "field"], "text", lexicon)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = conversation_verdicts(read_entries(table(spark, sf_dir, "entries"), content=False))
    return verdicts.where("reason is not null")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_entries(table(spark, sf_dir, "entries")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str, total=None) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mix_sources(sized, table(spark, sf_dir, "mix_targets"), total)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the largest mix in which every source holds its weight, with repetitions."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in that mix."""
    return _mixed(spark, sf_dir)[1]


def p9_shares_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a total far beyond what the caps allow: every source is clamped."""
    return _mixed(spark, sf_dir, total=1e15)[1]


def p9_shares_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same halfway from the largest true mix to all caps: clamped sources, redistributed excess."""
    return _mixed(spark, sf_dir, total=halfway)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrong_labels(
        table(spark, sf_dir, "documents"), "doc_id", "text", "lang",
        table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "lang_aliases"),
    )
    return found.select("doc_id", "segment_no", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return label_segments(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "lang_samples"))


QUERIES = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_mentions": p2_mentions,
    "p2_sanitised": p2_sanitised,
    "p5_found": p5_found,
    "p5_conversations": p5_conversations,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_shares_capped": p9_shares_capped,
    "p9_shares_filled": p9_shares_filled,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from logweave.llm.oracles import ORACLES

    return dict(ORACLES)
