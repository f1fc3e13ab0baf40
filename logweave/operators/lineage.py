"""Edges between agents: files written then read, messages, parents, and reused text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.runtime import cut


def artifact_edges(touches: DataFrame, scope: list[str], agent: str, path: str, at: str, writes: Column, reads: Column) -> DataFrame:
    """``scope, src, dst, paths, first_path``: ``dst`` read a file at or after ``src`` had written it.

    Touches are reduced before they meet: of a writer only the first write of a
    path matters, of a reader only the last read, so repeated touches of a hot
    file cost nothing. What is left is one row per true edge and path.
    """
    base = touches.where(F.col(path).isNotNull() & F.col(at).isNotNull())
    w = base.where(writes).groupBy(*scope, path).agg(F.lit(0).alias("__z"), F.count_distinct(agent).alias("writers"))
    written = base.where(writes).groupBy(*scope, path, F.col(agent).alias("src")).agg(F.min(at).alias("written_at"))
    read = base.where(reads).join(w.select(*scope, path), [*scope, path], "left_semi")
    read = read.groupBy(*scope, path, F.col(agent).alias("dst")).agg(F.max(at).alias("read_at"))
    met = written.join(read, [*scope, path]).where("src <> dst and read_at >= written_at")
    return met.groupBy(*scope, "src", "dst").agg(F.count(F.lit(1)).alias("paths"), F.min(path).alias("first_path"))


def hub_files(touches: DataFrame, scope: list[str], agent: str, path: str, writes: Column, reads: Column, more_than: int = 3) -> DataFrame:
    """Paths read more than ``more_than`` times and never written: ``reads, readers``. One aggregation, no anti join."""
    return touches.where(F.col(path).isNotNull()).groupBy(*scope, path).agg(
        F.count_if(reads).alias("reads"), F.count_distinct(F.when(reads, F.col(agent))).alias("readers"),
        F.count_if(writes).alias("__w"),
    ).where((F.col("__w") == 0) & (F.col("reads") > more_than)).drop("__w")


def write_conflicts(touches: DataFrame, scope: list[str], agent: str, path: str, writes: Column) -> DataFrame:
    """Paths with more than one writer: ``writers, write_count``."""
    return touches.where(writes & F.col(path).isNotNull()).groupBy(*scope, path).agg(
        F.count_distinct(agent).alias("writers"), F.count(F.lit(1)).alias("write_count")
    ).where("writers > 1")


def message_edges(sent: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, src, dst, messages``: messages ``(scope, src, to)`` whose recipient is a known name ``(scope, to, dst)``.

    A name that stands for nobody known makes no edge, nor does a message to oneself.
    """
    named = known.select(*scope, "to", "dst").distinct()
    met = sent.join(named, [*scope, "to"]).where("src <> dst")
    return met.groupBy(*scope, "src", "dst").agg(F.count(F.lit(1)).alias("messages"))


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != "")


def _shingled(df: DataFrame, keep: list[str], text: str, words: int) -> DataFrame:
    """``keep, grams``: the distinct word shingles of each text of so many words, as 64-bit hashes; words are ``[a-z0-9]+``."""
    base = df.select(*keep, _tokens(text).alias("w")).where(F.size("w") >= words)
    starts = F.sequence(F.lit(1), F.size("w") - words + 1)
    grams = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return base.select(*keep, F.array_distinct(grams).alias("grams"))


def shingles(df: DataFrame, keep: list[str], text: str, words: int = 8) -> DataFrame:
    """:func:`_shingled`, one row a shingle: ``keep, shingle``."""
    return _shingled(df, keep, text, words).select(*keep, F.explode("grams").alias("shingle"))


def containment(
    sources: DataFrame, targets: DataFrame, scope: list[str], src: str, dst: str, src_text: str, dst_text: str,
    words: int = 8, least: float = 0.15, run: int = 0,
) -> DataFrame:
    """``scope, src_class, dst_class, score``: share of a source's shingles found in a target, at least ``least``.

    With ``run``, also pairs under ``least`` whose texts have that many words in
    a row in common; as in the reference such a pair shares ``run - words + 1``
    shingles or more, and only those pairs are tested, on the words themselves.

    Equal texts of a scope are one class (its hash), so copies meet once; join
    members to classes by the hash of their text. Candidates come from an inverted
    index on ``(scope, shingle)`` over the rarest shingles only: of a source with
    ``n`` shingles that must share ``k``, some shared one is among the ``n - k + 1``
    that the fewest targets of its scope have, so the commonest ``k - 1``, which a
    boilerplate puts into every text, form no pair. Candidates are then counted
    exactly on their own shingles.
    """
    s = sources.select(*scope, F.xxhash64(src_text).alias("src_class"), F.col(src_text).alias("t")).where("t is not null").distinct()
    d = targets.select(*scope, F.xxhash64(dst_text).alias("dst_class"), F.col(dst_text).alias("t")).where("t is not null").distinct()
    a, b = cut(_shingled(s, [*scope, "src_class"], "t", words)), cut(_shingled(d, [*scope, "dst_class"], "t", words))
    target = b.select(*scope, "dst_class", F.explode("grams").alias("shingle"))
    spread = target.groupBy(*scope, "shingle").agg(F.count(F.lit(1)).alias("df"))
    # Of the shingles that no target has none can be shared; they count as the rarest.
    held = a.select(*scope, "src_class", F.size("grams").alias("n"), F.explode("grams").alias("shingle")).join(spread, [*scope, "shingle"])
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9))
    k = F.least(k, F.lit(run - words + 1)) if run else k
    commonest = F.row_number().over(W.partitionBy(*scope, "src_class").orderBy(F.col("df").desc(), "shingle"))
    rare = held.withColumn("place", commonest).where(F.col("place") > k - 1).select(*scope, "src_class", "shingle")
    asked = rare.join(target, [*scope, "shingle"]).select(*scope, "src_class", "dst_class").distinct()
    met = asked.join(a.withColumnRenamed("grams", "__a"), [*scope, "src_class"]).join(b.withColumnRenamed("grams", "__b"), [*scope, "dst_class"])
    common = F.size(F.array_intersect("__a", "__b"))
    pairs = met.select(*scope, "src_class", "dst_class", common.alias("c"), (common / F.size("__a")).alias("score"))
    columns = [*scope, "src_class", "dst_class", "score"]
    if not run:
        return pairs.where(F.col("score") >= least).select(*columns)
    pairs = cut(pairs.where((F.col("score") >= least) | (F.col("c") >= run - words + 1)))
    asked = pairs.where(F.col("score") < least).join(s.withColumnRenamed("t", "__s"), [*scope, "src_class"])
    asked = asked.join(d.withColumnRenamed("t", "__d"), [*scope, "dst_class"])
    runs = asked.where(F.arrays_overlap(_runs("__s", run), _runs("__d", run)))
    return pairs.where(F.col("score") >= least).select(*columns).unionByName(runs.select(*columns))


def _runs(text: str, words: int) -> Column:
    """All stretches of so many words of a text, as texts."""
    w = _tokens(text)
    starts = F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - words + 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, words), " "))


def fold_edges(exact: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with inferred evidence folded in: ``exact`` rows get ``score`` where both exist, others are added."""
    joined = exact.withColumn("__e", F.lit(True)).join(inferred, keys, "full")
    kind = F.when(F.col("__e"), F.col("kind")).otherwise("handoff")
    return joined.select(*keys, kind.alias("kind"), "score")


def without_fans(edges: DataFrame, scope: list[str], root: str = "main") -> DataFrame:
    """``edges`` with ``hidden``: an edge from ``root`` to a node that some other edge also reaches."""
    others = edges.where(F.col("src") != root).select(*scope, F.col("dst"), F.lit(True).alias("__o")).distinct()
    return edges.join(others, [*scope, "dst"], "left").withColumn(
        "hidden", (F.col("src") == root) & F.coalesce("__o", F.lit(False))
    ).drop("__o")
