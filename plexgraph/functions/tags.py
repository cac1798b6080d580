"""Tag references ``@Type/path#element:line{k=v}`` as structs, with what is wrong with those that aren't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Designators that references may start with.
TYPES = ("A", "AST", "C", "Cl", "Cfg", "Ctx", "D", "DB", "E", "F", "Fn", "G", "H", "I", "IT", "M", "R", "S", "T", "U", "V", "WS")
_BLOCK = r"^:(function|if|else|try|catch|for|while|switch|case|block)\{([^}]+)\}"


def parse(reference: Column) -> Column:
    """type, path, element, line, line_end, block, block_id, metadata (a map of strings), error; the first error ends the parse.

    A reference may end after its path; ``#`` needs an element, ``:`` a number, a range or a block, ``{`` its ``}``. Metadata values lose their
    quotes, and commas in quotes don't part entries. Null counts as empty.
    """
    r = F.trim(F.coalesce(reference, F.lit("")))
    group = lambda c, e, g=1: F.nullif(F.regexp_extract(c, e, g), F.lit(""))
    kind = group(r, r"^@([A-Z][A-Za-z0-9]*)/")
    rest = F.regexp_replace(r, r"^@[A-Z][A-Za-z0-9]*/", "")
    raw_path = F.regexp_extract(rest, r"^([^#:{]+)", 1)
    path = F.nullif(F.trim(raw_path), F.lit(""))
    after_path = F.regexp_replace(rest, r"^[^#:{]+", "")
    hashed = after_path.startswith("#")
    element = F.nullif(F.trim(F.regexp_extract(after_path, r"^#([^:{}]+)", 1)), F.lit(""))
    after_element = F.when(hashed, F.regexp_replace(after_path, r"^#[^:{}]*", "")).otherwise(after_path)
    colon = after_element.startswith(":")
    block, block_id = group(after_element, _BLOCK, 1), group(after_element, _BLOCK, 2)
    line, line_end = group(after_element, r"^:(\d+)(?:-(\d+))?", 1), group(after_element, r"^:(\d+)-(\d+)", 2)
    tail = F.regexp_replace(after_element, _BLOCK + r"|^:\d+(?:-\d+)?", "")
    braced, closed = tail.startswith("{"), tail.contains("}")
    body = F.trim(F.regexp_extract(tail, r"^\{([^}]*)\}", 1))
    pairs = F.regexp_extract_all(body, F.lit(r"([\w.-]+\s*[=:]\s*(?:\"[^\"]*\"|'[^']*'|\[[^\]]*\]|[^,]*))"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w.-]+)", 1), F.regexp_replace(F.trim(F.regexp_extract(p, r"^[\w.-]+\s*[=:](.*)$", 1)), r"^[\"']|[\"']$", "")))
    keys = F.transform(entries, lambda e: e["col1"])
    metadata = F.map_from_entries(F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), (F.array_position(F.reverse(keys), e["col1"]) == F.size(keys) - i).alias("last"))), lambda x: x["last"]).getField("e"))  # a later entry of a key wins
    error = (
        F.when(~r.startswith("@"), "no_at")
        .when(kind.isNull(), "type")
        .when(path.isNull(), "path")
        .when(path.rlike(r"(^|/)\.\.(/|$)|//|^/|\s{2,}|[<>|?*\"]"), "path")
        .when(hashed & element.isNull(), "element")
        .when(hashed & ~element.rlike(r"^[A-Za-z_$][\w$.\-]*$"), "element")
        .when(colon & block.isNull() & line.isNull(), "line")
        .when(braced & ~closed, "unclosed_metadata")
        .when(braced & (body != "") & (F.size(pairs) == 0), "metadata")
    )
    ok = error.isNull()
    give = lambda c: F.when(ok, c)
    return F.struct(
        give(kind).alias("type"), give(path).alias("path"), give(F.when(hashed, element)).alias("element"), give(line.cast("int")).alias("line"), give(line_end.cast("int")).alias("line_end"),
        give(block).alias("block"), give(block_id).alias("block_id"), give(F.when(braced, metadata)).alias("metadata"), error.alias("error"),
    )


def format_reference(type_: Column, path: Column, element: Column, line: Column) -> Column:
    """The reference that parses to these parts; null parts are left out."""
    part = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c.cast("string")), F.lit(""))
    return F.concat(F.lit("@"), type_, F.lit("/"), path, part("#", element), part(":", line))


def suggestions(type_: Column, types: tuple[str, ...] = TYPES, most: int = 2) -> Column:
    """Known designators within ``most`` edits of an unknown one, the nearest first; empty for known ones."""
    near = F.filter(F.array_sort(F.array(*[F.struct(F.levenshtein(type_, F.lit(t)).alias("n"), F.lit(t).alias("t")) for t in types])), lambda x: x["n"] <= most)
    return F.when(type_.isin(*types), F.array().cast("array<string>")).otherwise(F.transform(near, lambda x: x["t"]))


def verdict(reference: Column, types: tuple[str, ...] = TYPES) -> Column:
    """ok, or what a validator rejects first: the parse's error, an unknown type, a range that runs backwards."""
    say = lambda p: F.coalesce(p["error"], F.when(~p["type"].isin(*types), "unknown_type").when(p["line_end"] < p["line"], "range").otherwise("ok"))
    return F.transform(F.array(parse(reference)), say)[0]  # the parse once, though it is asked four times
