"""Paths through the runs of a session: weighted critical path and rank columns.

Sessions of a counted size (LOCAL nodes and edges at most) are solved in one pass,
one session a call. In larger ones nodes are peeled in rounds over the whole
cluster: a node is taken once every edge into it is settled, so each edge is read
once, in the round after its source, and rows are keyed by (scope, node). The
rounds follow the longest chain, not the number of nodes. Nodes on or behind a
cycle are never freed, so both ways end in any graph, with the same result.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.runtime import cut


#: A session with at most this many nodes, and edges, is solved in one task.
LOCAL = 100_000


def _by_size(nodes: DataFrame, links: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and links of the sessions of at most LOCAL rows each, and of the others."""
    size = nodes.select(*scope, F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(links.select(*scope, F.lit(0).alias("v"), F.lit(1).alias("e")))
    big = cut(size.groupBy(*scope).agg(F.sum("v").alias("v"), F.sum("e").alias("e")).where((F.col("v") > LOCAL) | (F.col("e") > LOCAL)).select(*scope))
    return (nodes.join(big, scope, "left_anti"), links.join(big, scope, "left_anti"),
            nodes.join(big, scope, "left_semi"), links.join(big, scope, "left_semi"))


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _in_degrees(nodes: DataFrame, links: DataFrame, scope: list[str]) -> DataFrame:
    into = links.groupBy(*scope, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    return nodes.join(into, [*scope, "node"], "left").withColumn("open", F.coalesce("open", F.lit(0)))


def rank_columns(nodes: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, node, rank``: length of the longest chain of edges that ends at the node.

    Edges between nodes on or behind a cycle do not count; such nodes come one
    after the highest of their other predecessors.
    """
    base = nodes.select(*scope, "node").distinct()
    ends = [base.withColumnRenamed("node", c) for c in ("src", "dst")]
    links = edges.where("src <> dst").select(*scope, "src", "dst").distinct()
    links = cut(links.join(ends[0], [*scope, "src"], "left_semi").join(ends[1], [*scope, "dst"], "left_semi"))
    few, few_links, base, many = _by_size(base, links, scope)
    fields = [*scope, "node", "rank"]

    def solve(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        into, out = defaultdict(int), defaultdict(list)
        for a, b in zip(edges["src"], edges["dst"], strict=True):
            into[b] += 1
            out[a].append(b)
        rank = dict.fromkeys(nodes["node"], 0)
        free, level = [n for n in rank if not into[n]], 0
        while free:
            level, after = level + 1, []
            for a in free:
                for b in out[a]:
                    into[b] -= 1
                    rank[b] = level
                    if not into[b]:
                        after.append(b)
            free = after
        return nodes.assign(rank=[rank[n] for n in nodes["node"]])[fields]

    local = few.groupBy(*scope).cogroup(few_links.groupBy(*scope)).applyInPandas(solve, _fields(few, fields[:-1]) + ", rank int")
    left, links = cut(_in_degrees(base, many, scope).withColumn("rank", F.lit(0))), many
    done, level = [], 0
    while True:
        free = left.where("open = 0").select(*scope, "node")
        if free.isEmpty():
            break
        done.append(free.withColumn("rank", F.lit(level)))
        met = links.join(free.withColumnRenamed("node", "src"), [*scope, "src"]).groupBy(*scope, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        level += 1
        left = left.where("open > 0").join(met, [*scope, "node"], "left")
        left = cut(left.select(*scope, "node", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"),
                               F.when(F.col("n").isNotNull(), F.lit(level)).otherwise(F.col("rank")).alias("rank")))
    out = local.unionByName(left.select(*scope, "node", "rank"))
    for part in done:
        out = out.unionByName(part)
    return out


def critical_path(spans: DataFrame, edges: DataFrame, scope: list[str], shown: int = 12, whole: bool = False) -> DataFrame:
    """``scope, node, score, end, steps, chain``: best time-weighted chain that ends at each node, with its last ``shown`` nodes.

    ``spans``: (scope, node, start, end). Along an edge forward in time a node adds
    ``max(0, end - max(start, end of the one before))``, or its own length if
    ``whole``; alone it scores its own length. Only edges forward in the order
    (start, end, node) count, so there are no cycles. Of equal chains the one with
    the least predecessor is taken, and none unless it scores more than the node alone.
    """
    base = cut(spans.select(*scope, "node", "start", "end"))
    a = base.select(*scope, F.col("node").alias("src"), F.col("start").alias("src_start"), F.col("end").alias("src_end"))
    b = base.select(*scope, F.col("node").alias("dst"), F.col("start").alias("dst_start"), F.col("end").alias("dst_end"))
    forward = edges.where("src <> dst").select(*scope, "src", "dst").distinct().join(a, [*scope, "src"]).join(b, [*scope, "dst"])
    own = F.col("dst_end") - F.col("dst_start")
    gain = own if whole else F.greatest(F.lit(0), F.col("dst_end") - F.greatest("dst_start", "src_end"))
    order = (F.col("src_start") < F.col("dst_start")) | ((F.col("src_start") == F.col("dst_start")) & (
        (F.col("src_end") < F.col("dst_end")) | ((F.col("src_end") == F.col("dst_end")) & (F.col("src") < F.col("dst")))))
    links = cut(forward.where(order).select(*scope, "src", "dst", gain.alias("gain")))
    few, few_links, base, links = _by_size(base, links, scope)
    fields = [*scope, "node", "end", "score", "steps", "chain"]
    columns = _fields(few, fields[:-3]) + ", score " + few.select((F.col("end") - F.col("start")).alias("x")).schema["x"].dataType.simpleString()

    def solve(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        into = defaultdict(list)
        for a, b, more in zip(edges["src"], edges["dst"], edges["gain"], strict=True):
            into[b].append((a, more))
        nodes = nodes.sort_values(["start", "end", "node"])
        score, steps, chain = {}, {}, {}
        for node, start, end in zip(nodes["node"], nodes["start"], nodes["end"], strict=True):
            offer, before = min(((-(score[a] + more), a) for a, more in into[node]), default=(0, None))
            alone = end - start
            if before is not None and -offer > alone + 1e-9:
                score[node], steps[node], chain[node] = -offer, steps[before] + 1, [*chain[before], node][-shown:]
            else:
                score[node], steps[node], chain[node] = alone, 1, [node]
        each = list(nodes["node"])
        return nodes.assign(score=[score[n] for n in each], steps=[steps[n] for n in each], chain=[chain[n] for n in each])[fields]

    local = few.groupBy(*scope).cogroup(few_links.groupBy(*scope)).applyInPandas(solve, columns + ", steps int, chain array<string>")
    left = _in_degrees(base, links, scope).select(
        *scope, "node", "end", "open", (F.col("end") - F.col("start")).alias("score"), F.lit(1).alias("steps"), F.array("node").alias("chain")
    )
    left = cut(left)
    done = []
    while True:
        free = left.where("open = 0").drop("open")
        if free.isEmpty():
            break
        done.append(free)
        offer = links.join(free.drop("end").withColumnRenamed("node", "src"), [*scope, "src"])
        total = F.col("score") + F.col("gain")
        best = offer.groupBy(*scope, F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct(total.alias("s"), F.col("src").alias("p"), "steps", "chain"), F.struct(-total, F.col("src"))).alias("o"),
        )
        joined = left.where("open > 0").join(best, [*scope, "node"], "left")
        # An equal offer of an earlier round stands only if its predecessor is the lesser one.
        level = F.col("o.s") == F.col("score")
        lesser = level & (F.col("steps") > 1) & (F.col("o.p") < F.element_at("chain", -2))
        better = F.coalesce((F.col("o.s") > F.col("score") + 1e-9) | lesser, F.lit(False))
        longer = F.concat(F.slice("o.chain", -F.least(F.size("o.chain"), F.lit(shown - 1)), F.lit(shown)), F.array("node"))
        left = cut(joined.select(
            *scope, "node", "end", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"),
            F.when(better, F.col("o.s")).otherwise(F.col("score")).alias("score"),
            F.when(better, F.col("o.steps") + 1).otherwise(F.col("steps")).alias("steps"),
            F.when(better, longer).otherwise(F.col("chain")).alias("chain"),
        ))
    out = local.unionByName(left.select(*fields))  # nothing is left: the order has no cycles
    for part in done:
        out = out.unionByName(part.select(*out.columns))
    return out
