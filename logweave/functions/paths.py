"""One spelling for texts that hold paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Where a path has an empty, ``.`` or ``..`` step or a slash at its end; all others are as they should be.
_FOLDS = r"//|/\.|(?:^| )\./|/(?: |$)"


def canonical_text(column: Column) -> Column:
    """Lower case, white space collapsed, and every path in one spelling.

    Words with a slash or backslash are paths: separators become ``/``, empty and
    ``.`` steps go, ``x/..`` goes, and so does a slash at the end. A leading slash
    stays. Null if nothing is left.
    """
    flat = F.trim(F.regexp_replace(F.lower(column), r"(?U)\s+", " "))
    word = lambda w: F.when(F.instr(w, "/") > 0, canonical_path(w)).otherwise(w)
    slashed = F.translate(flat, "\\", "/")
    text = F.when(~slashed.rlike(_FOLDS), slashed).otherwise(
        F.array_join(F.transform(F.split(slashed, " "), word), " ")
    )
    return F.when(F.length(text) > 0, text)


def canonical_path(word: Column) -> Column:
    """A path with ``/`` between its steps, without empty, ``.`` and undone steps."""

    def step(kept: Column, part: Column) -> Column:
        last = F.element_at(kept, -1)
        climbs = (part == "..") & (F.size(kept) > 0) & F.coalesce(~last.isin("..", ""), F.lit(False))
        return (
            F.when((part == "") | (part == "."), kept)
            .when(climbs, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    start = F.when(word.startswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    folded = F.array_join(F.aggregate(F.split(word, "/"), start, step), "/")
    return F.when(F.length(folded) > 0, folded).otherwise(F.when(word.startswith("/"), "/").otherwise("."))
