"""Schemas that drift between files: tagged-union inference, changes, one table.

Every JSON object is parsed once (VARIANT). Per file and path the engine keeps
the *set* of types seen (a tagged union: alternatives are retained, not widened)
with a profile of the content. Profiles are sums, so they fuse in map tasks: a
project with a third of all lines costs a few rows per map task. All later steps
work on these profiles, whose number follows files and fields, not lines.

A name that goes and a name that comes are one renamed field if the type is the
same, the content looks the same, and no file of the corpus ever has both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.lines import is_object, parse_line
from logweave.runtime import cut

#: Profiles of two names agree within these bounds (ratio of means; difference of shares).
LENGTH_RATIO, SHARE_GAP, MAGNITUDE_GAP, KEY_OVERLAP = 4.0, 0.5, 1.5, 0.3
#: Aliases are names of a schema; more than this is data used as keys, and an error.
MAX_ALIASES = 10_000
_PATH = r"^[\w.~@-]*([/\\][\w.~@*-]+)+$"
_NUMERIC = r"^\s*[+-]?\d+([.,]\d+)?\s*$"
_KEYS = ("keys0", "keys1", "keys2", "keys3")


def _kind(schema: Column) -> Column:
    """string, number, boolean, array, object, or null for a JSON null."""
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema != "VOID", "number")
    )


def _object_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _exploded(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per field: ``keep`` + (outer, inner, kind, value); inner null at the top.

    A line is parsed once and gives its outer and inner fields in one pass. A line
    without fields gives one row of nulls, so that its file is known.
    """
    def field(name, value):
        return F.struct(name.alias("inner"), _kind(F.schema_of_variant(value)).alias("kind"), value.alias("value"))

    top = df.select(*keep, F.explode_outer(F.map_entries(_object_map(F.col("__v")))).alias("e"))
    top = top.select(*keep, F.col("e.key").alias("outer"), F.col("e.value").alias("value"))
    top = top.withColumn("kind", _kind(F.schema_of_variant("value")))
    inner = F.transform(F.map_entries(_object_map(F.col("value"))), lambda e: field(e["key"], e["value"]))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("inner"), F.col("kind"), F.col("value")))
    every = F.when(F.col("kind") == "object", F.concat(itself, inner)).otherwise(itself)
    out = top.select(*keep, "outer", F.explode(every).alias("f")).select(*keep, "outer", "f.*")
    return out.where("kind is not null or outer is null")


def profile_fields(df: DataFrame, raw: str, project: str, file_no: str) -> DataFrame:
    """Per (project, file_no, outer, inner, kind): how often and what the content looks like.

    All figures are of fixed width: sums, and for the names inside objects four
    words of bits, one bit a name by its hash, so that an object whose names are
    data costs no more than another. Of each file one row without ``outer`` may remain.
    """
    base = df.select(
        F.col(project).alias("project"), F.col(file_no).alias("file_no"), parse_line(F.col(raw)).alias("__v")
    ).where("project is not null and file_no is not null")
    fields = _exploded(base, ["project", "file_no"])
    kind = F.col("kind")
    fields = fields.withColumns({
        "text": F.when(kind != "object", F.col("value").cast("string")),
        "hashes": F.when(kind == "object", F.transform(F.map_keys(_object_map(F.col("value"))), lambda k: F.xxhash64(k))),
    })
    text = F.col("text")
    share = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    number = F.when(kind == "number", text.try_cast("double"))
    slashed = F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\"))

    def bits(i: int) -> Column:
        mine = F.filter("hashes", lambda h: F.pmod(h, F.lit(len(_KEYS))) == i)
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 8), F.lit(64)).cast("int"))
        return F.bit_or(F.aggregate(mine, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(bit(h))))

    return fields.groupBy("project", "file_no", "outer", "inner", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(text)).alias("chars"),
        F.sum(F.length(text) - F.length(F.translate(text, " \t\r\n", "")) + 1).alias("words"),
        share(slashed & text.rlike(_PATH)).alias("paths"),
        share(text.rlike(_NUMERIC)).alias("numeric"),
        F.sum(F.log10(F.abs(number) + 1)).alias("magnitude"),
        *[F.coalesce(bits(i), F.lit(0).cast("long")).alias(k) for i, k in enumerate(_KEYS)],
    )


def _fused(profiles: DataFrame) -> DataFrame:
    """One row per field: its type set and its fused profile."""
    return profiles.groupBy("project", "file_no", "outer", "inner").agg(
        F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kind"),
        F.struct(
            *[(F.sum(c) / F.sum("n")).alias(c) for c in ("chars", "words", "paths", "numeric")],
            (F.sum("magnitude") / F.sum(F.when(F.col("kind") == "number", F.col("n")))).alias("magnitude"),
            *[F.bit_or(k).alias(k) for k in _KEYS],
        ).alias("look"),
    )


def _distance(kind: Column, a: Column, b: Column) -> Column:
    """How far two profiles of one type are apart; null if they are not alike."""
    ratio = lambda k: F.abs(F.log((a[k] + 1) / (b[k] + 1)))
    gap = lambda k: F.abs(a[k] - b[k])
    import math

    bound = math.log(LENGTH_RATIO)
    text_ok = (ratio("chars") <= bound) & (ratio("words") <= bound)
    text_ok &= (gap("paths") <= SHARE_GAP) & (gap("numeric") <= SHARE_GAP)
    text = F.when(text_ok, ratio("chars") + ratio("words") + gap("paths") + gap("numeric"))
    number = F.when(gap("magnitude") <= MAGNITUDE_GAP, gap("magnitude"))
    both = sum((F.bit_count(a[k].bitwiseAND(b[k])) for k in _KEYS), F.lit(0))
    either = sum((F.bit_count(a[k].bitwiseOR(b[k])) for k in _KEYS), F.lit(0))
    overlap = F.when(either == 0, 1.0).otherwise(both / either)
    keys = F.when(overlap >= KEY_OVERLAP, 1 - overlap)
    return (
        F.when(kind == "number", number).when(kind == "boolean", F.lit(0.0))
        .when(kind == "object", keys).otherwise(text)
    )


def _versions(files: DataFrame) -> DataFrame:
    """``(project, file_no, prev)``: each file with the next lower number present."""
    files = files.select("project", "file_no").distinct()
    order = W.partitionBy("project").orderBy("file_no")
    return files.withColumn("prev", F.lag("file_no").over(order)).where("prev is not null")


def _steps(fields: DataFrame, versions: DataFrame, place: list[str]) -> DataFrame:
    """Fields of each file beside the file before: ``now`` or ``was`` null if missing there."""
    cols = ["project", *place, "name", "kind", "look"]
    now = versions.join(fields, ["project", "file_no"]).select("file_no", *cols)
    was = fields.select(F.col("file_no").alias("prev"), *cols)
    was = versions.join(was, ["project", "prev"]).select(
        "project", "file_no", *place, "name", F.col("kind").alias("was"), F.col("look").alias("was_look")
    )
    return now.withColumnRenamed("kind", "now").join(
        was, ["project", "file_no", *place, "name"], "full"
    )


def _candidates(steps: DataFrame, place: list[str]) -> DataFrame:
    """Pairs of a name that goes and one that comes in one file and place, alike in type and content.

    Pairs arise only between names that change from one file to the next.
    """
    keys = ["project", "file_no", *place, "kind"]
    gone = steps.where("now is null").select(
        "project", "file_no", *place, F.col("was").alias("kind"), F.col("name").alias("old"),
        F.col("was_look").alias("old_look"),
    )
    come = steps.where("was is null").select(
        "project", "file_no", *place, F.col("now").alias("kind"), F.col("name").alias("new"),
        F.col("look").alias("new_look"),
    )
    far = _distance(F.col("kind"), F.col("old_look"), F.col("new_look"))
    pairs = gone.join(come, keys).withColumn("far", far).where("far is not null")
    return pairs.drop("old_look", "new_look")


def _never_together(pairs: DataFrame, fields: DataFrame, place: list[str]) -> DataFrame:
    """Drop pairs of names that some file of the corpus has both in that place."""
    asked = pairs.select(*place, "old", "new").distinct()
    seen = fields.select("project", "file_no", *place, "name").distinct()
    has_old = asked.join(seen.withColumnRenamed("name", "old"), [*place, "old"])
    both = has_old.join(
        seen.withColumnRenamed("name", "new"), ["project", "file_no", *place, "new"], "left_semi"
    ).select(*place, "old", "new").distinct()
    return pairs.join(both, [*place, "old", "new"], "left_anti")


def _mutual_best(pairs: DataFrame, place: list[str]) -> DataFrame:
    """One-to-one: each name keeps its nearest partner, ties by name."""
    at = ["project", "file_no", *place]
    by_new = W.partitionBy(*at, "new").orderBy("far", "old")
    by_old = W.partitionBy(*at, "old").orderBy("far", "new")
    return (
        pairs.withColumn("r1", F.row_number().over(by_new)).withColumn("r2", F.row_number().over(by_old))
        .where("r1 = 1 and r2 = 1").drop("r1", "r2")
    )


def _aliases(top: DataFrame, versions: DataFrame, tracked: Iterable[str]) -> dict[str, str]:
    """Every name a tracked top-level field goes by, with the name it is tracked under."""
    steps = _steps(top, versions, [])
    pairs = _never_together(_candidates(steps, []), top, [])
    votes = pairs.groupBy("old", "new").agg(F.count(F.lit(1)).alias("votes"), F.min("far").alias("far"))
    rows = votes.limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} renamed top-level names: keys look like data")
    concept = {name: name for name in tracked}
    grew = True
    while grew:
        grew = False
        for r in sorted(rows, key=lambda r: (-r["votes"], r["far"], r["old"], r["new"])):
            for known, other in ((r["old"], r["new"]), (r["new"], r["old"])):
                if known in concept and other not in concept:
                    concept[other] = concept[known]
                    grew = True
    return concept


def _concept_column(name: Column, concept: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in sorted(concept.items()) for x in kv])
    return F.element_at(mapping, name)


def field_model(
    df: DataFrame, raw: str, project: str, file_no: str, tracked: tuple[str, ...]
) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """``(fields, versions, top, aliases)`` shared by the report and the table."""
    profiles = cut(_fused(profile_fields(df, raw, project, file_no)))
    fields, versions = profiles.where("outer is not null"), cut(_versions(profiles))
    top = fields.where("inner is null").select("project", "file_no", F.col("outer").alias("name"), "kind", "look")
    return fields, versions, top, _aliases(top, versions, tracked)


def schema_changes(
    df: DataFrame,
    raw: str = "raw",
    project: str = "project",
    file_no: str = "file_no",
    tracked: tuple[str, ...] = ("type", "toolUseResult", "attachment"),
    nested: tuple[str, ...] = ("toolUseResult", "attachment"),
) -> DataFrame:
    """``(project, file_no, field, change)`` against the file before it in its project.

    ``tracked`` top-level fields are followed under every name they take; fields
    directly inside the ``nested`` ones are compared while the outer field itself
    is unchanged. A JSON null says nothing. Lines that are torn, no object, or
    null are ignored, and rows without project or file number too. ``retyped``
    compares the sets of types, so a file that mixes types differs from one that
    does not. Empty input gives an empty result; other columns do not matter.
    """
    fields, versions, top, concept = field_model(df, raw, project, file_no, tracked)
    mine = top.withColumn("concept", _concept_column(F.col("name"), concept)).where("concept is not null")
    steps = cut(_steps(mine.drop("concept"), versions, []))
    renamed = _mutual_best(
        _never_together(
            _candidates(steps, []).where(
                _concept_column(F.col("old"), concept) == _concept_column(F.col("new"), concept)
            ),
            top, [],
        ), [],
    )
    outer_changes = _changes(steps, renamed, [])
    stable = _stable(steps, concept, nested)
    place = ["concept", "outer"]
    inner_steps, pairs, _ = _nested_steps(fields, versions, stable, concept, nested)
    inner_changes = _changes(inner_steps, pairs, place)
    return outer_changes.select("project", "file_no", F.col("name").alias("field"), "change").unionByName(
        inner_changes.select("project", "file_no", F.concat_ws(".", "outer", "name").alias("field"), "change")
    )


def _stable(steps: DataFrame, concept: dict[str, str], nested: tuple[str, ...]) -> DataFrame:
    """Outer fields with inner ones that a file has as the file before it has them."""
    stable = steps.where("now = was").select("project", "file_no", F.col("name").alias("outer"))
    return stable.where(_concept_column(F.col("outer"), concept).isin(*nested))


def _nested_steps(
    fields: DataFrame, versions: DataFrame, stable: DataFrame, concept: dict[str, str], nested: tuple[str, ...]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(steps, renamed, inner)`` of the fields directly inside the nested ones."""
    inner = (
        fields.where("inner is not null")
        .withColumn("concept", _concept_column(F.col("outer"), concept))
        .where(F.col("concept").isin(*nested))
        .select("project", "file_no", "concept", "outer", F.col("inner").alias("name"), "kind", "look")
    )
    place = ["concept", "outer"]
    steps = cut(_steps(inner, versions, place).join(stable, ["project", "file_no", "outer"], "left_semi"))
    pairs = _never_together(_candidates(steps, place), inner.drop("outer"), ["concept"])
    return steps, _mutual_best(pairs, place), inner


def _inner_aliases(renamed: DataFrame, inner: DataFrame) -> dict[str, dict[str, str]]:
    """Per nested field the names that were renamed, each with the one name they go by in the table.

    Classes grow along the renames, the most frequent first, unless some file has
    a name of both. The name of a class is the one most files have.
    """
    votes = renamed.groupBy("concept", "old", "new").agg(F.count(F.lit(1)).alias("votes"), F.min("far").alias("far"))
    rows = votes.limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} renamed inner names: keys look like data")
    if not rows:
        return {}
    named = sorted({(r["concept"], n) for r in rows for n in (r["old"], r["new"])})
    asked = F.broadcast(inner.sparkSession.createDataFrame(named, "concept string, name string"))  # at most 2 * MAX_ALIASES
    seen = cut(inner.select("project", "file_no", "concept", "name").join(asked, ["concept", "name"]).distinct())
    files = {(r["concept"], r["name"]): r["n"] for r in seen.groupBy("concept", "name").agg(F.count(F.lit(1)).alias("n")).collect()}
    other = seen.withColumnRenamed("name", "other")
    met = seen.join(other, ["project", "file_no", "concept"]).where("name < other").select("concept", "name", "other").distinct()
    together = {(r["concept"], *sorted((r["name"], r["other"]))) for r in met.collect()}  # pairs of names of the schema
    of = {key: [key[1]] for key in named}
    for r in sorted(rows, key=lambda r: (-r["votes"], r["far"], r["concept"], r["old"], r["new"])):
        c = r["concept"]
        a, b = of[c, r["old"]], of[c, r["new"]]
        if a is not b and not any((c, *sorted((x, y))) in together for x in a for y in b):
            a += b
            for x in b:
                of[c, x] = a
    out: dict[str, dict[str, str]] = {}
    for (c, name), names in of.items():
        out.setdefault(c, {})[name] = min(names, key=lambda x: (-files.get((c, x), 0), x))
    return out


def _union_struct(value: Column, *more: Column) -> Column:
    """A value as ``(branch, text, number, flag, json)``, null for none or a JSON null."""
    kind, text = _kind(F.schema_of_variant(value)), value.cast("string")
    return F.when(kind.isNotNull(), F.struct(
        *more, kind.alias("branch"), text.alias("text"),
        F.when(kind == "number", text.try_cast("double"))
        .when(kind == "string", F.trim(text).try_cast("double")).alias("number"),
        F.when(kind == "boolean", text.try_cast("boolean")).alias("flag"),
        F.when(kind.isin("object", "array"), text).alias("json"),
    ))


def _inner_map(value: Column, aliases: dict[str, str]) -> Column:
    """Fields of an object by their canonical names, each as :func:`_union_struct` with its ``name`` in the line."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    entries = F.filter(entries, lambda e: _kind(F.schema_of_variant(e["value"])).isNotNull())
    names = F.transform(entries, lambda e: e["key"])
    moved = {a: c for a, c in aliases.items() if a != c}
    known = F.transform(names, lambda n: F.coalesce(_concept_column(n, moved), n)) if moved else names
    # Two names of one field in a line (no file that was compared has that) keep their own names.
    keys = F.when(F.size(F.array_distinct(known)) == F.size(known), known).otherwise(names)
    values = F.transform(entries, lambda e: _union_struct(e["value"], e["key"].alias("name")))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.map_from_arrays(keys, values))


def _changes(steps: DataFrame, renamed: DataFrame, place: list[str]) -> DataFrame:
    at = ["project", "file_no", *place]
    new = renamed.select(*at, F.col("new").alias("name"), F.lit("renamed").alias("how"))
    old = renamed.select(*at, F.col("old").alias("name"), F.lit("gone").alias("how"))
    marked = steps.where("now is null or was is null or now <> was").join(
        new.unionByName(old), [*at, "name"], "left"
    )
    change = (
        F.when(F.col("how") == "renamed", "renamed").when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed").otherwise("retyped")
    )
    return marked.where("how is null or how <> 'gone'").select(*at, "name", change.alias("change"))


def consistent_table(
    df: DataFrame,
    raw: str = "raw",
    project: str = "project",
    file_no: str = "file_no",
    keep: tuple[str, ...] = ("record_id", "project", "file_no", "line_no"),
    tracked: tuple[str, ...] = ("type", "toolUseResult", "attachment"),
    nested: tuple[str, ...] = ("toolUseResult", "attachment"),
) -> DataFrame:
    """All lines in one schema: per tracked field a tagged union.

    Each tracked field, under whatever name the line has it, becomes a struct
    ``(branch, text, number, flag, json)``: ``branch`` is the type found, the
    column of that type holds the value, and ``text`` is the canonical conversion
    every branch has. Each ``nested`` field also has a map ``<field>_fields`` from
    the canonical name of every field directly inside it to such a struct, with
    the ``name`` it has in the line; renames are those of :func:`schema_changes`.
    ``parsed`` is false for lines that are no JSON object; they stay in the table
    with null fields.
    """
    fields, versions, top, concept = field_model(df, raw, project, file_no, tracked)
    mine = top.where(_concept_column(F.col("name"), concept).isNotNull())
    stable = _stable(_steps(mine, versions, []), concept, nested)
    _, renamed, inner = _nested_steps(fields, versions, stable, concept, nested)
    aliases = _inner_aliases(renamed, inner)
    out = df.select(*keep, parse_line(F.col(raw)).alias("__v"))
    out = out.withColumn("parsed", is_object(F.col("__v")))
    out = out.withColumn("__m", _object_map(F.col("__v")))
    for name in tracked:
        spellings = [name] + sorted(a for a, c in concept.items() if c == name and a != name)
        got = F.coalesce(*[F.try_element_at("__m", F.lit(a)) for a in spellings])
        out = out.withColumn("__g", F.when(F.col("parsed"), got))
        out = out.withColumn(name, _union_struct(F.col("__g")))
        if name in nested:
            out = out.withColumn(f"{name}_fields", _inner_map(F.col("__g"), aliases.get(name, {})))
        out = out.drop("__g")
    return out.drop("__v", "__m")
