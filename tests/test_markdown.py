"""Documents and their sections."""

from plexgraph.sources import markdown

DOC = """---
subject: "Cache layer"
status: approved
documents: ./src/cache.ts
related_files: [src/a.ts, 'src/b.ts']
---
Prose before any heading with `lost`.
# Phase 3 — Proof
Uses `runCache()` and `not a name` and `runCache`.
```ts
// helper(1)
import { a, b as c } from './x';
import Foo from 'y';
const z = new Bar(obj.skip(1), call("q(1)"));
# no heading
```
~~~
```
# nor this
~~~
## Phase 3: Proof
## ---
### Last `one`
"""


def test_sections(spark):
    got = markdown.split_sections(DOC)
    assert [(s["slug"], s["depth"], s["line"], s["end_line"]) for s in got] == [("phase-3-proof", 1, 8, 20), ("phase-3-proof-2", 2, 21, 21), ("section-3", 2, 22, 22), ("last-one", 3, 23, 24)]
    assert got[0]["mentions"] == ["runCache"]
    assert got[0]["identifiers"] == ["a", "b", "Foo", "Bar", "call"]
    assert got[3]["mentions"] == ["one"]
    df = spark.createDataFrame([("docs/x.md", DOC), ("e.md", ""), ("n.md", None)], "path string, content string")
    rows = markdown.sections(df, "path").collect()
    assert [r["slug"] for r in rows] == [s["slug"] for s in got]
    assert [r.lines for r in rows] == [13, 1, 1, 2]


def test_facts(spark):
    rows = [("docs/resource-sheets/cache.md", DOC), ("docs/resource-sheets/bare.md", "# no matter"), ("docs/foundation-docs/api.md", "# x"), ("docs/r.md", "---\ntitle: T\ningestion_candidate: TRUE\nrelated_files:\n  - a.ts\n  - b.ts\n---\n"), ("docs/s.md", "---\ntitle: T\n---\n"), ("x.ts", DOC)]
    got = {r.path: r for r in markdown.doc_facts(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert set(got) == {rows[0][0], rows[2][0], rows[3][0]}
    a, b, c = (got[rows[i][0]] for i in (0, 2, 3))
    assert (a.slug, a.doc_type, a.subject, a.status, a.documents, a.related_files) == ("cache", "resource-sheet", "Cache layer", "approved", "src/cache.ts", ["src/a.ts", "src/b.ts"])
    assert (b.doc_type, b.status) == ("foundation", "generated")
    assert (c.subject, c.status, c.related_files) == ("T", "draft", ["a.ts", "b.ts"])
