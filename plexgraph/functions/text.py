"""Column functions: identifier tokens, paths, routes, classification; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half towards plus infinity."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def lexical_tokens(text: Column) -> Column:
    """Lower-cased identifier parts: cut at what is neither letter nor digit, where a capital follows none, and between
    letters and digits; a run of capitals stays whole. Lower-cased last, so that other letters never turn into ASCII ones."""
    return F.transform(identifier_parts(text), lambda x: F.lower(x))


def identifier_parts(text: Column) -> Column:
    """The parts in their own case; one pass over the text."""
    cut = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    return F.array_remove(F.split(text, cut), "")


def canonical_path(url: Column) -> Column:
    """The path of an address as an endpoint: no scheme, host, query or fragment; parameters as {}; single slashes."""
    x = F.regexp_replace(url, r"[#?].*$", "")
    x = F.regexp_replace(x, r"^[a-z]+://[^/]*", "")
    x = F.regexp_replace(x, r"\{[^}/]*\}|:[A-Za-z_][A-Za-z0-9_]*|<[^>/]*>|\[[^\]/]*\]", "{}")
    x = F.regexp_replace(F.concat(F.lit("/"), x), r"/+", "/")
    return F.regexp_replace(x, r"(.)/$", "$1")


def heading_slug(title: Column) -> Column:
    """A heading as an anchor."""
    x = F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9 _-]", "")
    return F.regexp_replace(x, r"[ ]+", "-")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4.0)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
