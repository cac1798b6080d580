"""Changes of signatures that break callers, and how bad they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETERS = "array<struct<name:string,type:string,optional:boolean>>"


def parameter_change(before: Column, after: Column) -> Column:
    """added (a required one), removed, reordered (names differ place by place), type-changed, or null; in that order.

    Both are arrays of structs (name, type, optional); optional parameters that are added break nobody.
    """
    before, after = F.coalesce(before, F.array().cast(PARAMETERS)), F.coalesce(after, F.array().cast(PARAMETERS))
    n, m = F.size(before), F.size(after)
    new = F.slice(after, n + 1, F.greatest(m - n, F.lit(0)))
    both = F.zip_with(before, F.slice(after, 1, n), lambda a, b: F.struct((~a["name"].eqNullSafe(b["name"])).alias("name"), (~a["type"].eqNullSafe(b["type"])).alias("type")))
    return (
        F.when((m > n) & F.exists(new, lambda p: ~F.coalesce(p["optional"], F.lit(False))), "added")
        .when(m < n, "removed")
        .when(F.exists(both, lambda p: p["name"]), "reordered")
        .when(F.exists(both, lambda p: p["type"]), "type-changed")
    )


def signature_change(before: Column, after: Column) -> Column:
    """The first change of two structs (parameters, returns, exported): signature, return, visibility, or null."""
    returns = lambda s: F.coalesce(F.nullif(s["returns"], F.lit("")), F.lit("void"))
    return (
        F.when(parameter_change(before["parameters"], after["parameters"]).isNotNull(), "signature")
        .when(returns(before) != returns(after), "return")
        .when(F.coalesce(before["exported"], F.lit(False)) & ~F.coalesce(after["exported"], F.lit(False)), "visibility")
    )
