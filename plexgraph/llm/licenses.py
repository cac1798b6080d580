"""Licence scan by ordered signature rules, in DataFrame functions only; one narrow pass without a shuffle.

Each rule is a regular expression with a label, a priority and a keyword that all of its matches hold. A cheap alternation of what
matches hold gates whole texts, the keyword gates each rule, and only then its expression runs over the whole text, A-Z lower-cased. Detections are intervals;
sorted by start, longer and higher priority first, one fold keeps those not contained in an interval of higher
priority, or in a longer one of their own. Cost per row is linear in its text, and a sort and a few hundred copies a detection.

Besides the rules, three base phrases are counted as consecutive words, and the words of every text.

Defined results: null and empty texts have no words, no places and no labels (score 0); every input row gives one row, so repeated
rows repeat; equal intervals of one priority all stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import NO_WORD, ascii_lower, let, words

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
SCORES = {3: 0.99, 2: 0.9, 1: 0.6}

#: Label, keyword (in all that the name matches), hand-written name; each gives a tagged form, a grant form and the bare name.
_NAMES = r"""
mit|mit|mit licen[sc]e
mit|expat|expat licen[sc]e
mit|x11|x11 licen[sc]e
mit-0|mit|mit no attribution
apache-1.0|apache|apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.0
apache-1.1|apache|apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1
apache-2.0|apache|apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?
apache|apache|apache (?:software )?licen[sc]e
bsd-1-clause|bsd|bsd[ -]1[ -]clause
bsd-2-clause|bsd|(?:simplified |freebsd |bsd[ -]2[ -]clause|2[ -]clause bsd)(?: licen[sc]e)?
bsd-3-clause|bsd|(?:bsd[ -]3[ -]clause|3[ -]clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)?
bsd-4-clause|bsd|(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)(?: licen[sc]e)?
0bsd|bsd|(?:zero[ -]clause bsd|0bsd)
bsd|bsd|bsd(?:[ -]style)? licen[sc]e
gpl-1.0|general public|(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)1
gpl-2.0|general public|(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)2
gpl-3.0|general public|(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)3
gpl|general public|gnu general public licen[sc]e
gpl-2.0|gpl|gpl[ -]?v?2(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?
gpl-3.0|gpl|gpl[ -]?v?3(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?
lgpl-2.0|lesser|lesser general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?
lgpl-2.0|library|library general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?
lgpl-2.1|lesser|lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1
lgpl-3.0|lesser|lesser general public licen[sc]e,? (?:version |v\.? ?)3
lgpl|lesser|(?:gnu )?lesser general public licen[sc]e
lgpl-2.1|lgpl|lgpl[ -]?v?2\.1(?:[ -](?:only|or[ -]later)|\+)?
lgpl-3.0|lgpl|lgpl[ -]?v?3(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?
agpl-3.0|affero|affero general public licen[sc]e(?:,? (?:version |v\.? ?)3)?
agpl-3.0|agpl|agpl[ -]?v?3(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?
mpl-1.0|mozilla|mozilla public licen[sc]e,? (?:version |v\.? ?)1\.0
mpl-1.1|mozilla|mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1
mpl-2.0|mozilla|mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?
mpl|mozilla|mozilla public licen[sc]e
epl-1.0|eclipse|eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)1(?:\.0)?
epl-2.0|eclipse|eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)2(?:\.0)?
epl|eclipse|eclipse public licen[sc]e
cddl-1.0|common development|common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)1\.0)?
cddl-1.1|common development|common development and distribution licen[sc]e,? (?:version |v\.? ?)1\.1
cpl-1.0|common public|common public licen[sc]e(?:,? (?:version |v\.? ?)1\.0)?
ipl-1.0|ibm public|ibm public licen[sc]e
eupl-1.1|european union public|european union public licen[sc]e,? (?:version |v\.? ?)1\.1
eupl-1.2|european union public|european union public licen[sc]e(?:,? (?:version |v\.? ?)1\.2)?
artistic-1.0|artistic|artistic licen[sc]e(?:,? (?:version )?1\.0)?
artistic-2.0|artistic|artistic licen[sc]e,? (?:version )?2(?:\.0)?
zlib|zlib|zlib(?:/libpng)? licen[sc]e
libpng|libpng|libpng licen[sc]e
bsl-1.0|boost|boost software licen[sc]e(?:,? (?:version |- version )?1\.0)?
busl-1.1|business source|business source licen[sc]e(?:,? (?:version )?1\.1)?
isc|isc|isc licen[sc]e
unlicense|unlicen|(?:the )?unlicen[sc]e
wtfpl|wtfpl|wtfpl
wtfpl|what the f|do what the f[u*]ck you want to public licen[sc]e
python-2.0|python|python (?:software foundation )?licen[sc]e(?:,? version 2)?
php-3.01|php|php licen[sc]e(?:,? version 3\.01)?
ruby|ruby|ruby(?:'s)? licen[sc]e
openssl|openssl|openssl licen[sc]e
ssleay|ssleay|ssleay licen[sc]e
w3c|w3c|w3c (?:software (?:notice and )?)?licen[sc]e
postgresql|postgresql|postgresql licen[sc]e
ncsa|illinois|university of illinois/ncsa open source licen[sc]e
upl-1.0|universal permissive|universal permissive licen[sc]e
afl-3.0|academic free|academic free licen[sc]e
osl-3.0|open software|open software licen[sc]e
ofl-1.1|open font|(?:sil )?open font licen[sc]e
ms-pl|microsoft|microsoft public licen[sc]e
ms-rl|microsoft|microsoft reciprocal licen[sc]e
qpl-1.0|q public|q public licen[sc]e
sspl-1.0|server side public|server side public licen[sc]e
elastic-2.0|elastic|elastic licen[sc]e(?: 2\.0)?
odbl-1.0|open database|open database licen[sc]e
odc-by-1.0|open data commons|open data commons attribution licen[sc]e
pddl-1.0|public domain dedication|public domain dedication and licen[sc]e
gfdl-1.2|free documentation|free documentation licen[sc]e,? version 1\.2
gfdl-1.3|free documentation|free documentation licen[sc]e,? version 1\.3
gfdl|free documentation|(?:gnu )?free documentation licen[sc]e
llama-2|llama 2|llama 2 community licen[sc]e
llama-3|llama 3|(?:meta )?llama 3(?:\.\d)? community licen[sc]e
openrail|rail|(?:bigscience|creativeml)?[ -]?open ?rail(?:-[ms]{1,2})?(?: licen[sc]e)?
bigscience-rail|bigscience|bigscience (?:bloom )?rail licen[sc]e
cecill-2.1|cecill|cecill(?:-[bc])?(?: (?:free software )?licen[sc]e)?
sleepycat|sleepycat|sleepycat licen[sc]e
vim|vim|vim licen[sc]e
intel|intel|intel open source licen[sc]e
nasa-1.3|nasa|nasa open source agreement
sgi-b-2.0|sgi|sgi free software licen[sc]e b
tcl|tcl|tcl/tk licen[sc]e
unicode|unicode|unicode (?:inc\. )?licen[sc]e agreement
x11|x consortium|x consortium licen[sc]e
xfree86|xfree86|xfree86 licen[sc]e
zpl-2.1|zope|zope public licen[sc]e
curl|curl|curl licen[sc]e
json|json|json licen[sc]e
mulanpsl-2.0|mulan|mulan (?:permissive software|psl)(?: licen[sc]e)?
blueoak-1.0.0|blue oak|blue oak model licen[sc]e
parity-7.0.0|parity|parity public licen[sc]e
polyform|polyform|polyform [a-z]+ licen[sc]e
commons-clause|commons clause|commons clause
proprietary|proprietary|proprietary (?:and confidential|licen[sc]e)
"""
#: Rules of a form of their own: priority, label, keyword, expression.
_FORMS = r"""
3|mit|permission is hereby|permission is hereby granted,? free of charge,? to any person obtaining a copy
2|mit|without restriction|to deal in the software without restriction
3|isc|permission to use|permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose
3|bsd|redistribution and use|redistribution and use in source and binary forms,? with or without modification
2|bsd-3-clause|neither the name|neither the name of [^.]{1,80} nor the names of its contributors
2|bsd-4-clause|advertising|all advertising materials mentioning features
3|zlib|as-is|this software is provided 'as-is',? without any express or implied warranty
3|gpl|free software|this (?:program|library|file) is free software[;:,]? you can redistribute it
2|gpl|warranty|without even the implied warranty of merchantability or fitness
3|apache-2.0|apache|licen[sc]ed under the apache licen[sc]e,? (?:version |v)2
3|mpl-2.0|mozilla|subject to the terms of the mozilla public licen[sc]e,? v\. ?2
3|unlicense|public domain|free and unencumbered software released into the public domain
2|public-domain|public domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
1|public-domain|public domain|public domain
3|wtfpl|everyone is|everyone is permitted to copy and distribute verbatim or modified
2|warranty-disclaimer|as is|provided [\"']?as is[\"']?,? without warranty of any kind
2|copyright|copyright|copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:[-, ]+(?:19|20)\d\d)*
1|copyright|copyright|copyright
2|copyright|all rights|all rights reserved
2|cc0-1.0|cc0|cc0(?:[ -]1\.0)?(?: universal)?
2|cc-by-nc-nd|noncommercial|attribution[ -]noncommercial[ -]noderiv(?:ative)?s?
2|cc-by-nc-sa|noncommercial|attribution[ -]noncommercial[ -]sharealike
2|cc-by-nc|commercial|attribution[ -]non-?commercial
2|cc-by-sa|sharealike|attribution[ -]sharealike
2|cc-by-nd|noderiv|attribution[ -]noderiv(?:ative)?s?
3|cc|creative commons|licen[sc]ed under (?:a |the )?creative commons
2|cc|creative commons|creative commons (?:attribution )?licen[sc]e
1|cc|creative commons|creative commons
1|generic-licence|licen|licen[sc]ed (?:under|to)
1|generic-licence|licen|(?:this|the) licen[sc]e(?![a-z])
1|generic-licence|licen|terms of (?:the|this) licen[sc]e
3|spdx|spdx|spdx-licen[sc]e-identifier: ?[a-z0-9.+-]+
"""
_CC = tuple((f"cc-{k}{'-' + v if v else ''}", k, v) for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("", "1.0", "2.0", "2.5", "3.0", "4.0"))


def rules() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword, expression."""
    out = []
    for line in _NAMES.strip().splitlines():
        label, keyword, name = line.split("|", 2)
        out.append((label, 3, keyword, rf"(?:licen[sc]ed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?(?:{name})"))
        out.append((label, 2, keyword, rf"(?<![a-z0-9])(?:{name})(?![a-z0-9])"))
    for line in _FORMS.strip().splitlines():
        priority, label, keyword, expression = line.split("|", 3)
        out.append((label, int(priority), keyword, expression))
    for label, kind, version in _CC:
        flexible = kind.replace("-", "[ -]") + (rf"[ -]{version.replace('.', '[.]')}" if version else "")
        out.append((label, 2, "cc", rf"(?<![a-z0-9])cc[ -]{flexible}(?![a-z0-9])"))
        if version:
            out.append((label, 3, "creativecommons", rf"creativecommons\.org/licenses/{kind}/{version.replace('.', '[.]')}"))
    return out


#: What every text that a rule or a base phrase can match holds, in any case of A-Z.
GATE = r"(?i)(?:licen[sc]|gpl|copyright|public domain|creative ?commons|spdx|permission |redistribution|as[ -]is|warrant|all rights|neither the name|everyone is|advertising|free software|cc0|wtfpl|commons clause|proprietary|bsd|unlicen|rail|cecill|mulan|nasa open|what the f|mit no attribution|non-?commercial|sharealike|noderiv|without restriction|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by)"


def _rule_array() -> Column:
    rows = ", ".join(f"named_struct('label', '{a}', 'p', {p}, 'k', '{k}', 'r', {_quoted(r)})" for a, p, k, r in rules())
    return F.expr(f"array({rows})")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def prefix_sums(x: Column, chunk: int = 256) -> Column:
    """Running sums of an array of int. Arrays grow by copying, so sums run within chunks and over the chunks' totals:
    a few hundred copies an element instead of as many as the array is long."""

    def run(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(part, start, lambda a, v: F.struct((a["t"] + v).alias("t"), F.concat(a["o"], F.array(a["t"] + v)).alias("o")))["o"]

    def sums(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda i: run(F.slice(v, i * chunk + 1, F.lit(chunk))))
        return let(parts, lambda p: F.flatten(F.zip_with(p, run(F.transform(p, lambda q: F.element_at(q, -1))), lambda q, total: F.transform(q, lambda y: y + total - F.element_at(q, -1)))))

    return let(x, lambda v: F.when(F.size(v) > 0, sums(v)).otherwise(F.array().cast("array<int>")))


def _intervals(low: Column, rule: Column) -> Column:
    """All matches of the rule as structs in sorting order: start, minus end, minus priority, label.

    A match starts after all pieces between matches and all matches before it.
    """
    none = F.array().cast("array<struct<s:int,e:int,p:int,label:string>>")

    def placed(found: Column) -> Column:
        before = F.zip_with(F.slice(F.split(low, rule["r"], -1), 1, F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.size(found) - 1)), lambda piece, last: F.char_length(piece) + F.char_length(last))
        return F.zip_with(prefix_sums(before), found, lambda s, m: F.struct(s.alias("s"), (-(s + F.char_length(m))).alias("e"), (-rule["p"]).alias("p"), rule["label"].alias("label")))

    return let(F.regexp_extract_all(low, rule["r"], F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _kept(found: Column) -> Column:
    """Labels and best priority of the detections that none contains; ``found`` is sorted."""
    state = "struct<m1:int,m2:int,m3:int,s:int,e:int,p:int,labels:array<string>,best:int>"

    def step(a, x):
        s, e, p = x["s"], -x["e"], -x["p"]
        top = F.when(p == 1, a["m1"]).when(p == 2, a["m2"]).otherwise(a["m3"])
        keep = (top < e) | ((a["s"] == s) & (a["e"] == e) & (a["p"] == p))
        up = [F.when(p >= q, F.greatest(a[f"m{q}"], e)).otherwise(a[f"m{q}"]).alias(f"m{q}") for q in (1, 2, 3)]
        last = [F.when(keep, v).otherwise(a[n]).alias(n) for n, v in (("s", s), ("e", e), ("p", p))]
        return F.struct(*up, *last, F.when(keep, F.array_union(a["labels"], F.array(x["label"]))).otherwise(a["labels"]).alias("labels"), F.when(keep, F.greatest(a["best"], p)).otherwise(a["best"]).alias("best")).cast(state)

    start = F.struct(*[F.lit(-1).alias(n) for n in ("m1", "m2", "m3", "s", "e", "p")], F.array().alias("labels"), F.lit(0).alias("best")).cast(state)
    return F.aggregate(found, start, step)


def detections(low: Column) -> Column:
    """Surviving labels and best priority of a lower-cased text."""
    rule_hits = let(_rule_array(), lambda every: F.filter(every, lambda r: F.contains(low, r["k"])))
    found = F.array_sort(F.flatten(F.transform(rule_hits, lambda r: _intervals(low, r))))
    return _kept(found)


def _base(w: Column) -> Column:
    """Places of the base phrases among words: their number, smallest and largest start, labels."""
    joined = F.concat(F.lit("/"), F.array_join(w, "//"), F.lit("/"))

    def count(piece: Column) -> Column:
        return ((F.char_length(piece) - F.char_length(F.replace(piece, F.lit("/"), F.lit("")))) / 2).cast("long")

    def phrase(j: Column, text: str, label: str) -> Column:
        m = len(text.split())
        return let(
            F.split(j, "/" + text.replace(" ", "//") + "/", -1),
            lambda x: F.struct((F.size(x) - 1).cast("long").alias("n"), F.when(F.size(x) > 1, count(x[0])).alias("a"), F.when(F.size(x) > 1, count(j) - count(F.element_at(x, -1)) - m).alias("z"), F.when(F.size(x) > 1, F.lit(label)).alias("label")),
        )

    return let(
        let(joined, lambda j: F.array(*[phrase(j, *b) for b in BASE])),
        lambda x: F.struct(F.aggregate(x, F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n"), F.array_min(F.transform(x, lambda p: p["a"])).alias("a"), F.array_max(F.transform(x, lambda p: p["z"])).alias("z"), F.array_sort(F.array_compact(F.transform(x, lambda p: p["label"]))).alias("labels")),
    )


def count_words(text: Column) -> Column:
    """How many words a text has; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), NO_WORD)
    return let(parts, lambda x: F.size(x) - (x[0] == "").cast("int") - ((F.size(x) > 1) & (F.element_at(x, -1) == "")).cast("int")).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with the number of words, base places, labels and score of every row."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("z"), F.array().cast("array<string>").alias("labels"))
    hit = F.coalesce(F.col("text").rlike(GATE), F.lit(False))
    rows = docs.select("doc_id", count_words(F.col("text")).alias("n_words"), F.when(hit, F.struct(_base(words(F.col("text"))).alias("b"), let(ascii_lower(F.col("text")), detections).alias("d"))).alias("x"))
    b, d = F.coalesce("x.b", none), F.col("x.d")
    rule = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SCORES.items() for v in kv]), d["best"]), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", b["n"].alias("n_base"), b["a"].alias("first_word"), b["z"].alias("last_word"), F.array_join(b["labels"], ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(b["labels"], F.coalesce(d["labels"], F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(b["n"] > 0, 0.95).otherwise(0.0), rule).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, licence phrases, labels and score of every document."""
    return scan(table(spark, sf_dir, "documents"))
