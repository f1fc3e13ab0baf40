"""Queries over API calls: token totals, series, peaks, cache rebuilds, context."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.text import model_short
from logweave.operators import latest, sequences, series
from logweave.runtime import strip, table

KEYS = ["session_id", "transcript_id", "mid"]
FRESH = "input_tokens + output_tokens + cache_create"


def deliveries(spark, d):
    """Model messages with an identifier, still once per delivery."""
    mid = strip(F.col("message_id"))
    raw = table(spark, d, "api_calls").where("operation is null").withColumn("mid", mid)
    return raw.where("mid <> ''")


def messages(spark, d):
    """One row per message: time and place as first delivered, model and usage as last delivered."""
    return latest.usage_latest_wins(
        deliveries(spark, d), KEYS, ["received_at", "delivery_id"], ["at_s"],
        ["model", "cache_create", "cache_read", "input_tokens", "output_tokens"],
    )


def usage_latest_wins(spark, d):
    return messages(spark, d).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read").alias("cache_read"),
        F.sum("cache_create").alias("cache_create"),
    )


def tokens_by_model(spark, d):
    total = F.expr("sum(input_tokens) + sum(cache_read) + sum(cache_create)")
    return messages(spark, d).groupBy(model_short(F.col("model")).alias("model")).agg(
        F.expr(f"sum({FRESH})").alias("fresh"), F.sum("cache_read").alias("cache_read"),
        F.round(F.try_divide(F.sum("cache_read"), total), 6).alias("cache_hit"),
    )


def top_transcripts(spark, d):
    per = messages(spark, d).groupBy("session_id", "transcript_id").agg(F.expr(f"sum({FRESH})").alias("fresh"))
    order = W.partitionBy("session_id").orderBy(F.col("fresh").desc(), "transcript_id")
    return per.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 8")


def unlisted_models(spark, d):
    """Messages by the first rule their model matches; those without any are unlisted."""
    rules = [("haiku*", "small"), ("sonnet*", "medium"), ("opus-x-2026*", "large dated")]
    rule = latest.first_match_rule(messages(spark, d), F.col("model"), rules, "unlisted")
    return messages(spark, d).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def spend_running_bins(spark, d):
    m = messages(spark, d).where("at_s is not null")
    return series.cumulative_bins(m, ["session_id"], "at_s", F.expr(FRESH), 12)


def limit_crossing(spark, d):
    m = messages(spark, d).where("at_s is not null")
    out = series.crossing(m, ["session_id"], "at_s", F.expr(FRESH), {"warned_at": 8000, "reached_at": 10000})
    return out.select("session_id", F.round("warned_at", 3).alias("warned_at"), F.round("reached_at", 3).alias("reached_at"))


def peak_5min(spark, d):
    m = messages(spark, d).where("at_s is not null").withColumn("us", F.round(F.col("at_s") * 1e6).cast("long"))
    return series.peak_window(m, ["session_id"], "us", F.expr(FRESH), 300_000_000)


def pace_now(spark, d):
    m = messages(spark, d).where("at_s is not null").withColumn("us", F.round(F.col("at_s") * 1e6).cast("long"))
    return series.pace(m, ["session_id"], "us", F.expr(FRESH), 300_000_000)


def pulse_bins(spark, d):
    m = messages(spark, d).where("at_s is not null")
    return series.binned(m, ["session_id"], "at_s", 48).groupBy("session_id", "bin").agg(F.count(F.lit(1)).alias("calls"))


def activity_comb(spark, d):
    m = messages(spark, d).where("at_s is not null")
    bins = series.binned(m, ["transcript_id"], "at_s", 28).groupBy("transcript_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("bin", "n")))
    return bins.groupBy("transcript_id").agg(  # at most 28 values
        F.array_join(F.transform(packed, lambda x: F.concat_ws(":", x["bin"], x["n"])), ",").alias("comb")
    )


def cache_rebuilds(spark, d):
    m = messages(spark, d).where("at_s is not null")
    back = sequences.step_back(m, ["session_id", "transcript_id"], ["at_s", "mid"], ["at_s", "model"])
    idle = F.col("at_s") - F.col("prev_at_s")
    cause = (
        F.when(F.col("prev_model") != F.col("model"), "model").when(idle >= 3600, "idle 1 h").when(idle >= 300, "idle 5 min")
        .otherwise("unknown")
    )
    built = back.where("prev_at_s is not null and cache_create >= 1000 and cache_read < 0.2 * cache_create")
    return built.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.sum("cache_create").alias("tokens"))


def context_peak(spark, d):
    size = F.expr("cache_create + cache_read + input_tokens")
    m = messages(spark, d).withColumn("size", size)
    limit = F.when(F.contains(F.lower("model"), F.lit("haiku")), 200_000).otherwise(1_000_000)
    out = m.withColumn("lim", limit).groupBy("transcript_id").agg(
        F.max("size").alias("peak"), F.max_by("lim", F.struct("size", "mid")).alias("of"),
        F.max_by("size", F.struct("at_s", "mid")).alias("latest"),
    )
    return out.withColumn("fill", F.round(F.col("peak") / F.col("of"), 6))


def pressure_series(spark, d):
    m = messages(spark, d).where("at_s is not null").withColumn("size", F.expr("cache_create + cache_read + input_tokens"))
    m = m.withColumn("us", F.round(F.col("at_s") * 1e6).cast("long"))
    m = m.groupBy("session_id", "us").agg(F.max("size").alias("size"))
    return series.thinned(m, ["session_id"], "us", "size", 24)


def token_events(spark, d):
    """What each delivery adds to its message's fresh tokens; falls are left out."""
    w = W.partitionBy(*KEYS).orderBy("received_at", "delivery_id")
    fresh = deliveries(spark, d).withColumn("fresh", F.expr(FRESH))
    gain = F.col("fresh") - F.coalesce(F.lag("fresh").over(w), F.lit(0))
    return fresh.withColumn("gain", gain).where("gain > 0").select("delivery_id", "gain")


def queue_balance(spark, d):
    q = table(spark, d, "api_calls").where("operation is not null").withColumn("mid", strip(F.col("message_id")))
    q = q.where("mid <> ''").select("session_id", "mid", "operation").distinct()
    return q.groupBy("session_id").agg(
        F.count_if(F.col("operation") == "enqueue").alias("enqueued"), F.count_if(F.col("operation") == "remove").alias("removed")
    )


def late_batches(spark, d):
    """Deliveries of a batch that came after a later batch had begun."""
    calls = table(spark, d, "api_calls")
    began = calls.groupBy("batch_no").agg(F.min("received_at").alias("began"), F.max("received_at").alias("ended"), F.count(F.lit(1)).alias("n"))
    after = F.min("began").over(W.orderBy(F.col("batch_no").desc()).rowsBetween(W.unboundedPreceding, -1))  # one row a batch
    return began.withColumn("next_began", after).select(
        "batch_no", "n", (F.coalesce(F.col("ended") > F.col("next_began"), F.lit(False))).alias("overtaken")
    )


def session_history(spark, d):
    """A history table after an upsert of the second half of the sessions' summaries over the first."""
    m = messages(spark, d).where("at_s is not null")
    early = m.groupBy("session_id").agg(F.min("at_s").alias("first_seen"), F.min("at_s").alias("seen"), F.lit(0).cast("long").alias("messages"))
    late = m.groupBy("session_id").agg(F.max("at_s").alias("first_seen"), F.max("at_s").alias("seen"), F.count(F.lit(1)).alias("messages"))
    out = latest.upsert(early, late, "session_id", "seen", "first_seen", keep_rows=500)
    return out.select("session_id", F.round("first_seen", 3).alias("first_seen"), F.round("seen", 3).alias("seen"), "messages")


def compare_sessions(spark, d):
    """Each session against the one before it by time: change and share of messages."""
    m = messages(spark, d).where("at_s is not null").groupBy("session_id").agg(F.min("at_s").alias("at"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("day", F.floor(F.col("at") / 86_400))
    order = W.partitionBy("day").orderBy("at", "session_id")
    days = m.groupBy("day").agg(F.max_by("n", F.struct("at", "session_id")).alias("last"))
    carried = days.select("day", F.lag("last").over(W.orderBy("day")).alias("carried"))  # one row a day
    m = m.withColumn("own", F.lag("n").over(order)).join(carried, "day").withColumn("b", F.coalesce("own", "carried"))
    return m.select(
        "session_id", "n", (F.col("n") - F.col("b")).alias("change"), F.round(F.try_divide(F.col("n") - F.col("b"), F.col("b")), 6).alias("pct")
    )


QUERIES = {f.__name__: f for f in (
    usage_latest_wins, tokens_by_model, top_transcripts, unlisted_models, spend_running_bins, limit_crossing, peak_5min,
    pace_now, pulse_bins, activity_comb, cache_rebuilds, context_peak, pressure_series, token_events, queue_balance,
    late_batches, session_history, compare_sessions,
)}

_D = r"""WITH d AS (SELECT *, regexp_replace(message_id, '^\s+|\s+$', '', 'g') AS mid FROM api_calls WHERE operation IS NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id, transcript_id, mid ORDER BY received_at DESC, delivery_id DESC) AS rn,
          first_value(at_s) OVER (PARTITION BY session_id, transcript_id, mid ORDER BY received_at, delivery_id) AS at0 FROM d WHERE mid <> ''),
  m AS (SELECT * EXCLUDE (at_s, at0), at0 AS at_s, input_tokens + output_tokens + cache_create AS fresh,
          CAST(round(at0 * 1e6) AS BIGINT) AS us FROM r WHERE rn = 1)
"""
_BIN = """, s AS (SELECT {k}, min(at_s) AS lo, max(at_s) AS hi FROM m WHERE at_s IS NOT NULL GROUP BY 1),
  b AS (SELECT m.*, CAST(least(CASE WHEN hi > lo THEN floor((at_s - lo) / ((hi - lo) / {n})) ELSE 0 END, {n} - 1) AS INT) AS bin
        FROM m JOIN s USING ({k}) WHERE at_s IS NOT NULL)
"""
ORACLES = {
    "usage_latest_wins": _D + """SELECT session_id, count(*) AS messages, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
        CAST(sum(cache_create) AS BIGINT) AS cache_create FROM m GROUP BY 1""",
    "tokens_by_model": _D + r"""SELECT regexp_replace(regexp_replace(model, '^claude-', ''), '-\d{8}$', '') AS model, CAST(sum(fresh) AS BIGINT) AS fresh,
        CAST(sum(cache_read) AS BIGINT) AS cache_read,
        round(sum(cache_read) / nullif(sum(input_tokens) + sum(cache_read) + sum(cache_create), 0), 6) AS cache_hit FROM m GROUP BY 1""",
    "top_transcripts": _D + """, p AS (SELECT session_id, transcript_id, CAST(sum(fresh) AS BIGINT) AS fresh FROM m GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fresh DESC, transcript_id) AS place FROM p QUALIFY place <= 8""",
    "unlisted_models": _D + """SELECT CASE WHEN lower(model) LIKE 'haiku%' THEN 'small' WHEN lower(model) LIKE 'sonnet%' THEN 'medium'
        WHEN lower(model) LIKE 'opus-x-2026%' THEN 'large dated' ELSE 'unlisted' END AS rule, count(*) AS n FROM m GROUP BY 1""",
    "spend_running_bins": _D + _BIN.format(k="session_id", n=12) + """, t AS (SELECT session_id, bin, sum(fresh) AS total FROM b GROUP BY 1, 2),
        f AS (SELECT s.session_id, CAST(x.bin AS INT) AS bin, CAST(coalesce(total, 0) AS BIGINT) AS total FROM s
              CROSS JOIN range(12) x(bin) LEFT JOIN t ON t.session_id = s.session_id AND t.bin = x.bin)
        SELECT *, CAST(sum(total) OVER (PARTITION BY session_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM f""",
    "limit_crossing": _D + """, c AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY at_s, mid ROWS UNBOUNDED PRECEDING) AS run FROM m WHERE at_s IS NOT NULL)
        SELECT session_id, round(min(at_s) FILTER (run >= 8000), 3) AS warned_at, round(min(at_s) FILTER (run >= 10000), 3) AS reached_at FROM c GROUP BY 1""",
    "peak_5min": _D + """, w AS (SELECT session_id, us, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 299999999 FOLLOWING) AS BIGINT) AS total
          FROM m WHERE at_s IS NOT NULL)
        SELECT session_id, us AS opened, total FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total DESC, us) = 1""",
    "pace_now": _D + """, l AS (SELECT session_id, max(us) AS t FROM m WHERE at_s IS NOT NULL GROUP BY 1)
        SELECT session_id, CAST(sum(CASE WHEN t - us < 300000000 THEN fresh ELSE 0 END) AS BIGINT) AS now,
        CAST(sum(CASE WHEN t - us >= 300000000 AND t - us < 600000000 THEN fresh ELSE 0 END) AS BIGINT) AS before
        FROM m JOIN l USING (session_id) WHERE at_s IS NOT NULL GROUP BY 1""",
    "pulse_bins": _D + _BIN.format(k="session_id", n=48) + "SELECT session_id, bin, count(*) AS calls FROM b GROUP BY 1, 2",
    "activity_comb": _D + _BIN.format(k="transcript_id", n=28) + """, n AS (SELECT transcript_id, bin, count(*) AS n FROM b GROUP BY 1, 2)
        SELECT transcript_id, string_agg(bin || ':' || n, ',' ORDER BY bin) AS comb FROM n GROUP BY 1""",
    "cache_rebuilds": _D + """, w AS (SELECT *, lag(at_s) OVER o AS pa, lag(model) OVER o AS pm FROM m WHERE at_s IS NOT NULL
          WINDOW o AS (PARTITION BY session_id, transcript_id ORDER BY at_s, mid))
        SELECT CASE WHEN pm <> model THEN 'model' WHEN at_s - pa >= 3600 THEN 'idle 1 h' WHEN at_s - pa >= 300 THEN 'idle 5 min' ELSE 'unknown' END AS cause,
        count(*) AS n, CAST(sum(cache_create) AS BIGINT) AS tokens FROM w
        WHERE pa IS NOT NULL AND cache_create >= 1000 AND cache_read < 0.2 * cache_create GROUP BY 1""",
    "context_peak": _D + """, z AS (SELECT *, cache_create + cache_read + input_tokens AS size,
          CASE WHEN contains(lower(model), 'haiku') THEN 200000 ELSE 1000000 END AS lim FROM m),
        a AS (SELECT transcript_id, size AS peak, lim AS "of" FROM z QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY size DESC NULLS LAST, mid DESC) = 1),
        b AS (SELECT transcript_id, size AS latest FROM z QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY at_s DESC NULLS LAST, mid DESC) = 1)
        SELECT transcript_id, peak, "of", latest, round(peak / "of", 6) AS fill FROM a JOIN b USING (transcript_id)""",
    "pressure_series": _D + """, p AS (SELECT session_id, us, max(cache_create + cache_read + input_tokens) AS size FROM m WHERE at_s IS NOT NULL GROUP BY 1, 2),
        n AS (SELECT *, ntile(24) OVER (PARTITION BY session_id ORDER BY us) AS b FROM p)
        SELECT session_id, us, size FROM n QUALIFY row_number() OVER (PARTITION BY session_id, b ORDER BY size DESC, us) = 1""",
    "token_events": _D + """, g AS (SELECT delivery_id, input_tokens + output_tokens + cache_create AS f,
          lag(input_tokens + output_tokens + cache_create) OVER (PARTITION BY session_id, transcript_id, mid ORDER BY received_at, delivery_id) AS pf FROM d WHERE mid <> '')
        SELECT delivery_id, f - coalesce(pf, 0) AS gain FROM g WHERE f - coalesce(pf, 0) > 0""",
    "queue_balance": r"""WITH q AS (SELECT DISTINCT session_id, regexp_replace(message_id, '^\s+|\s+$', '', 'g') AS mid, operation FROM api_calls WHERE operation IS NOT NULL)
        SELECT session_id, count(*) FILTER (operation = 'enqueue') AS enqueued, count(*) FILTER (operation = 'remove') AS removed FROM q WHERE mid <> '' GROUP BY 1""",
    "late_batches": """WITH b AS (SELECT batch_no, min(received_at) AS began, max(received_at) AS ended, count(*) AS n FROM api_calls GROUP BY 1)
        SELECT batch_no, n, coalesce(ended > min(began) OVER (ORDER BY batch_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS overtaken FROM b""",
    "session_history": _D + """SELECT session_id, round(min(at_s), 3) AS first_seen, round(max(at_s), 3) AS seen, count(*) AS messages FROM m WHERE at_s IS NOT NULL GROUP BY 1
        ORDER BY max(at_s) DESC, session_id LIMIT 500""",
    "compare_sessions": _D + """, n AS (SELECT session_id, min(at_s) AS tm, count(*) AS n FROM m WHERE at_s IS NOT NULL GROUP BY 1),
        b AS (SELECT *, lag(n) OVER (ORDER BY tm, session_id) AS b FROM n)
        SELECT session_id, n, n - b AS change, round((n - b) / b, 6) AS pct FROM b""",
}
