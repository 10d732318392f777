"""Paths that name the same file, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = r"\\|(^|/)\.{0,2}(/|$)|^\s|\s$"


def canonical_path(path: Column) -> Column:
    """One spelling for each file: outer white space and ``.`` steps dropped, back-slashes and repeated slashes made one
    slash, ``x/..`` resolved. A null stays null; a leading slash and leading ``..`` steps stay.

    The step-wise form runs only for the paths that need it.
    """
    plain = F.regexp_replace(F.trim(F.regexp_replace(path, r"^\s+|\s+$", "")), r"\\", "/")
    steps = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x))),
    )
    full = F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))
    return F.when(path.rlike(_ODD), full).otherwise(path)
