"""Parent-child links to full hierarchies: Euler tours and parallel list ranking.

1. *Peel leaves.* A node that nobody points at is peeled; then every pointer is
   squared (parent -> ancestor at twice the distance). Each round so doubles the
   height that is peeled away, and only nodes **on** cycles are never peeled:
   the number of rounds is the logarithm of the height, not the height.
2. *Euler tour.* Cycle nodes are taken out; what hangs below them, below an
   unknown id, or below nothing is a forest. Every node gives an entry and an
   exit element; each element has one successor (first child, next sibling, or
   the parent's exit), so a tree is a linked list.
3. *List ranking* by pointer jumping gives each element the number of elements
   and the sum of levels to the end of its list, and the list's end. Successors
   are unique at every step, so no join of this phase can be skewed, whatever
   the shape of the trees.

Entry and exit ranks are intervals that nest as the nodes do: they give depth,
root, number of descendants, and ancestor tests without any walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.runtime import cut

#: Children of one parent are ordered in this many buckets, so that a parent
#: with a third of all rows as children is not one window partition.
SIBLING_BUCKETS = 256
#: Why a tree ends where it ends.
ROOT, ORPHAN, BELOW_CYCLE = 0, 1, 2


def _numbered(links: DataFrame, node: str, parent: str) -> DataFrame:
    """``(id, parent, v)``: one row per node with a dense-enough stable number.

    Nodes are unique afterwards; of rows that disagree on the parent the smallest
    non-null parent counts. Null ids are no nodes.
    """
    nodes = (
        links.select(F.col(node).alias("id"), F.col(parent).alias("parent"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    return cut(nodes.withColumn("v", F.monotonically_increasing_id()))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes ``v`` on cycles of ``(v, p)`` edges (``p`` never null, one row per ``v``)."""
    rest = cut(edges.select("v", F.col("p").alias("up")))
    left = rest.count()
    while left:
        aimed = rest.select(F.col("up").alias("v")).where("v is not null").distinct()
        kept = rest.join(aimed, "v", "left_semi")
        jump = kept.select(F.col("v").alias("j"), F.col("up").alias("next"))
        rest = cut(
            kept.join(jump, F.col("up") == F.col("j"), "left").select("v", F.col("next").alias("up"))
        )
        now = rest.count()
        if now == left:
            break
        left = now
    return rest.select("v")


def _euler_lists(forest: DataFrame, buckets: int) -> DataFrame:
    """Elements ``(e, nxt, n, w, last, kind)`` of the tours of ``(v, p, kind)``.

    Element ``2v`` enters node ``v`` and ``2v+1`` leaves it. ``p`` is null for the
    root of a tree; only there ``kind`` is set.
    """
    slot = F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int")
    children = forest.where("p is not null").withColumn("b", slot)
    inside = W.partitionBy("p", "b").orderBy("v")
    chained = children.withColumn("sib", F.lead("v").over(inside))
    # One row per (parent, bucket): at most ``buckets`` rows for any parent.
    heads = children.groupBy("p", "b").agg(F.min("v").alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(W.partitionBy("p").orderBy("b")))
    chained = chained.join(heads.select("p", "b", "after"), ["p", "b"]).select(
        "v", "p", F.coalesce("sib", "after").alias("sib")
    )
    first_child = heads.groupBy("p").agg(F.min_by("head", "b").alias("child")).withColumnRenamed("p", "v")
    exits = chained.select(
        (F.col("v") * 2 + 1).alias("e"),
        F.when(F.col("sib").isNotNull(), F.col("sib") * 2).otherwise(F.col("p") * 2 + 1).alias("nxt"),
        F.lit(None).cast("long").alias("last"), F.lit(None).cast("int").alias("kind"),
    )
    ends = forest.where("p is null").select(
        (F.col("v") * 2 + 1).alias("e"), F.lit(None).cast("long").alias("nxt"),
        F.col("v").alias("last"), F.col("kind"),
    )
    entries = forest.select("v").join(first_child, "v", "left").select(
        (F.col("v") * 2).alias("e"),
        F.coalesce(F.col("child") * 2, F.col("v") * 2 + 1).alias("nxt"),
        F.lit(None).cast("long").alias("last"), F.lit(None).cast("int").alias("kind"),
    )
    both = exits.unionByName(ends).unionByName(entries)
    level = F.when(F.col("e") % 2 == 0, 1).otherwise(-1).cast("long")
    return both.withColumns({"n": F.lit(1).cast("long"), "w": level})


def rank_lists(elements: DataFrame) -> DataFrame:
    """Pointer jumping: ``n`` and ``w`` become sums to the end of each list.

    ``elements``: ``(e, nxt, n, w, last, kind)``; ``last``/``kind`` are set at the
    ends and reach every element. Each round doubles the distance jumped; rounds
    are the logarithm of the longest list. Lists must not be circular.
    """
    width = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cut(elements.select("e", "nxt", "n", "w", "last", "kind"))
    while not state.where("nxt is not null").isEmpty():
        for _ in range(2):
            target = state.select(
                F.col("e").alias("te"), F.col("nxt").alias("tnxt"), F.col("n").alias("tn"),
                F.col("w").alias("tw"), F.col("last").alias("tlast"), F.col("kind").alias("tkind"),
            )
            active = state.where("nxt is not null").join(target, F.col("nxt") == F.col("te")).select(
                "e", F.col("tnxt").alias("nxt"), (F.col("n") + F.col("tn")).alias("n"),
                (F.col("w") + F.col("tw")).alias("w"),
                F.col("tlast").alias("last"), F.col("tkind").alias("kind"),
            )
            state = active.unionByName(state.where("nxt is null"))
        state = cut(state.coalesce(width))  # unions would add their partitions up, round by round
    return state


def hierarchy(
    links: DataFrame, node: str, parent: str, buckets: int = SIBLING_BUCKETS
) -> DataFrame:
    """Full hierarchy of ``(node, parent)`` rows of unknown depth.

    Returns one row per distinct non-null node: ``id``, ``parent``, ``kind``
    (``root``, ``orphan``: its line ends at an id that is no node, ``cycle``: its
    line goes round), and for nodes whose line ends: ``top`` (the tree's topmost
    node), ``depth`` (nodes from ``top`` to this one; 1 for ``top``),
    ``descendants`` (their number), ``enter`` and ``leave``. In one tree ``a`` is
    ``d`` or an ancestor of it exactly if ``a.enter >= d.enter`` and
    ``a.leave <= d.leave``. For nodes on or below a cycle these are null.

    A null parent makes a root, also beside other rows of the node only if all
    are null. Repeated rows count once. An empty table gives an empty result.
    """
    nodes = _numbered(links, node, parent)
    target = nodes.select(F.col("id").alias("pid"), F.col("v").alias("p"))
    linked = cut(
        nodes.where("parent is not null").join(target, F.col("parent") == F.col("pid"), "left")
        .select("v", "p", F.when(F.col("p").isNull(), ORPHAN).alias("kind"))
        .unionByName(
            nodes.where("parent is null").select(
                "v", F.lit(None).cast("long").alias("p"), F.lit(ROOT).alias("kind"))
        )
    )
    circular = cycle_nodes(linked.where("p is not null").select("v", "p"))
    if circular.isEmpty():
        forest = linked
    else:
        off = linked.join(circular, "v", "left_anti")
        under = circular.select(F.col("v").alias("p"), F.lit(True).alias("hangs"))
        forest = off.join(under, "p", "left").select(
            "v",
            F.when(F.col("hangs").isNull(), F.col("p")).alias("p"),
            F.when(F.col("hangs"), BELOW_CYCLE).otherwise(F.col("kind")).alias("kind"),
        )
        forest = cut(forest)
    ranked = rank_lists(_euler_lists(forest, buckets))
    per_node = (
        ranked.groupBy(F.floor(F.col("e") / 2).cast("long").alias("v"))
        .agg(
            F.max(F.when(F.col("e") % 2 == 0, F.col("n"))).alias("enter"),
            F.max(F.when(F.col("e") % 2 == 1, F.col("n"))).alias("leave"),
            F.max(F.when(F.col("e") % 2 == 0, F.col("w"))).alias("sum"),
            F.max("last").alias("last"),
            F.max("kind").alias("kind"),
        )
    )
    full = nodes.join(per_node, "v", "left")
    lost = F.coalesce(F.col("kind"), F.lit(BELOW_CYCLE)) == BELOW_CYCLE
    clear = lambda c: F.when(~lost, c)
    return full.select(
        "v", "id", "parent",
        F.when(lost, "cycle").when(F.col("kind") == ORPHAN, "orphan").otherwise("root").alias("kind"),
        clear(F.col("last")).alias("top_v"),
        clear(1 - F.col("sum")).alias("depth"),
        clear(F.floor((F.col("enter") - F.col("leave") - 1) / 2).cast("long")).alias("descendants"),
        clear(F.col("enter")).alias("enter"), clear(F.col("leave")).alias("leave"),
    )


def _lines(tree: DataFrame) -> DataFrame:
    """``(v, line)``: ids from the top to each node that is not on or below a cycle.

    Pointer doubling over the parents: the logarithm of the depth in rounds. The
    ids of all lines are the size of the result itself.
    """
    sound = tree.where("kind <> 'cycle'")
    ids = sound.select(F.col("id").alias("pid"), F.col("v").alias("up"))
    state = cut(
        sound.select("v", "id", "parent").join(ids, F.col("parent") == F.col("pid"), "left")
        .select("v", "up", F.array("id").alias("line"))
    )
    while not state.where("up is not null").isEmpty():
        target = state.select(
            F.col("v").alias("tv"), F.col("up").alias("tup"), F.col("line").alias("tline")
        )
        longer = F.when(F.col("tline").isNull(), F.col("line")).otherwise(F.concat("tline", "line"))
        state = cut(
            state.join(target, F.col("up") == F.col("tv"), "left").select(
                "v", F.col("tup").alias("up"), longer.alias("line")
            )
        )
    return state.select("v", "line")


def with_paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """Add ``top`` (id) and ``path`` (ids from ``top`` to the node) to :func:`hierarchy`. Null on or below cycles."""
    named = tree.select(F.col("v").alias("nv"), F.col("id").alias("top"))
    paths = _lines(tree).select("v", F.array_join("line", separator).alias("path"))
    return (
        tree.join(paths, "v", "left")
        .join(named, F.col("top_v") == F.col("nv"), "left")
        .drop("nv", "top_v")
    )


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)``: every descendant of every node not on or below a cycle.

    Each node's own ancestors are exploded, so a node with very many descendants is no group.
    """
    up = _lines(tree).select(F.element_at("line", -1).alias("descendant"), F.size("line").alias("n"), F.posexplode("line").alias("pos", "ancestor"))
    return up.where("pos < n - 1").select("ancestor", "descendant", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))
