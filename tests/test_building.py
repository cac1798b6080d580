"""Resolution, logs, context, matching, stores and runs on small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from plexgraph import jobs
from plexgraph.functions import similarity
from plexgraph.operators import context, interval, match, resolution, vectors
from plexgraph.sources import artifacts, extract, logs, scan


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_globs():
    import re

    def hit(pattern, path):
        return bool(re.search(scan.glob_regex(pattern), path))

    assert hit("dist/", "a/dist/x.js")
    assert not hit("dist/", "a/dist.js")
    assert hit("**/*.min.js", "x.min.js")
    assert hit("**/*.min.js", "a/b/x.min.js")
    assert hit("src/*.ts", "src/a.ts")
    assert not hit("src/*.ts", "src/b/a.ts")
    assert hit("notes", "a/notes/b.md")
    assert hit("./src/gen", "src/gen/x.ts")
    assert scan.glob_regex("# no") is scan.glob_regex("  ") is None


def test_discovery(spark, tmp_path):
    for name, text in (("src/a.ts", "let a"), ("src/b.py", "b = 1"), ("node_modules/x/c.ts", "no"), ("d.txt", "no"), ("e.gen.ts", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in scan.discover(spark, str(tmp_path), ignores=["*.gen.ts"]).collect()}
    assert got == {("src/a.ts", "ts", "let a"), ("src/b.py", "py", "b = 1")}
    assert scan.discover(spark, f"file://{tmp_path}", ["py"]).count() == 1


def test_masking_and_ranks():
    text = "// function no()\nconst s = 'class No {'; /* class No */\nexport const useIt = () => {};\nexport function Widget() {}\n"
    found = scan.scan_text(text, scan.Registry().ordered("ts"))
    assert found == [("hook", "useIt", 3, True), ("component", "Widget", 4, True)]
    with pytest.raises(ValueError, match="group"):
        scan.Registry().register("ts", scan.Pattern("x", "a", 1))


def test_broken_python_is_one_fact():
    assert [f["fact"] for f in extract.python_facts("def (")] == ["error"]
    c = extract.python_facts("async def f(a, *, b):\n    for x in a:\n        if x and b or x:\n            return [y for y in x if y]\n    return None\n")
    (f,) = [x for x in c if x["fact"] == "element"]
    assert (f["cyclomatic"], f["nesting"], f["names"], f["asynchronous"]) == (6, 2, ["a", "b"], True)


def test_reexports_end_on_cycles(spark):
    table = frame(spark, [("a", "x", "reexport", None, "b", "y"), ("b", "y", "reexport", None, "c", None), ("c", "y", "named", "C#y", None, None), ("p", "*", "reexport", None, "q", None), ("q", "*", "reexport", None, "p", None), ("q", "z", "named", "Q#z", None, None)], "file string, exported string, kind string, origin string, via string, local string")
    wanted = frame(spark, [("a", "x"), ("c", "y"), ("p", "z"), ("p", "nothing"), ("zz", "x")], "module string, binding string")
    got = {(r.module, r.binding): (r.origin, r.hops) for r in resolution.follow_exports(wanted, table).collect()}
    assert got == {("a", "x"): ("C#y", 2), ("c", "y"): ("C#y", 0), ("p", "z"): ("Q#z", 1)}


def test_relative_modules(spark):
    rows = [("src/a/b.ts", "./c"), ("src/a/b.ts", "../d.js"), ("b.ts", "./x/../y")]
    got = frame(spark, rows, "s string, m string").select(resolution.module_file(F.col("s"), F.col("m")).alias("p")).collect()
    assert [r.p for r in got] == ["src/a/c", "src/d.js", "y"]


def test_heritage_takes_the_nearest_level(spark):
    links = frame(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "A"), ("D", "E")], "sub string, sup string")
    own = frame(spark, [("C", "run", "C.run"), ("D", "run", "D.run"), ("D", "stop", "D.stop"), ("E", "stop", "E.stop")], "class string, method string, id string")
    wanted = frame(spark, [("A", "run"), ("A", "stop"), ("E", "run")], "class string, method string")
    got = {(r["class"], r.method, r.id, r.level) for r in resolution.heritage_lookup(wanted, links, own).collect()}
    assert got == {("A", "run", "C.run", 1), ("A", "stop", "D.stop", 2)}


def test_numstat(spark):
    m = logs.MARK
    text = f"1\t1\tearly\n{m}h1{m}ann{m}100\n3\t1\tsrc/{{old => new}}/a.ts\n-\t-\tx.png\n2\t0\tsrc/new/a.ts\n{m}h2{m}{m}\n1\t1\tb => c.ts\nnot a row\n"
    got = {tuple(r)[2:] for r in logs.numstat(frame(spark, [(1, text)], "log_id int, log string")).collect()}
    assert got == {("h1", "ann", 100, "src/new/a.ts", 3, 1), ("h1", "ann", 100, "x.png", 0, 0), ("h1", "ann", 100, "src/new/a.ts", 2, 0), ("h2", None, None, "c.ts", 1, 1)}
    churn = {tuple(r) for r in logs.churn(logs.numstat(frame(spark, [(1, text)], "log_id int, log string"))).collect()}
    assert churn == {("src/new/a.ts", 1, 5, 1), ("x.png", 1, 0, 0), ("c.ts", 1, 1, 1)}


def test_intervals(spark):
    import itertools

    hunks = [(i, i + w) for i, w in itertools.product(range(0, 60, 7), (0, 3, 20))]
    spans = [(s, e) for s, e in itertools.product(range(0, 80, 11), (5, 40, None))]
    got = interval.overlaps(frame(spark, hunks, "lo int, hi int"), frame(spark, [(s, None if e is None else s + e) for s, e in spans], "start int, end int"), 8).collect()
    want = [(lo, hi, s, e) for lo, hi in hunks for s, e in spans if s <= hi and (e is None or s + e >= lo)]
    assert len(got) == len(want)


def test_packing_stops_at_the_first_that_does_not_fit(spark):
    focus = frame(spark, [("p", "f", "x" * 40)], "pack string, id string, source string")
    near = frame(spark, [("p", "a", 1, "y" * 100), ("p", "b", 2, "z" * 4000), ("p", "c", 3, "w"), ("p", "f", 0, "again")], "pack string, id string, rank int, source string")
    got = {r.id: r.included for r in context.pack_context(focus, near, 100).collect()}
    assert got == {"f": True, "a": True, "b": False, "c": False}


def test_compression_keeps_signatures(spark):
    text = "export function f() {\n    body();\n    more();\n}\n\n    not a body\n# head\n  - item\n"
    assert frame(spark, [(text,)], "t string").select(context.compressed(F.col("t")).alias("c")).first().c == "export function f() {\n  // ...\n}\n\n    not a body\n# head\n  - item\n"


def test_skeleton_ranks_and_fits(spark):
    files = frame(spark, [(f, 1) for f in "abcd"], "id string, score int")
    edges = frame(spark, [("a", "b"), ("c", "b"), ("d", "b"), ("b", "c"), ("a", "c"), ("a", "a"), ("zz", "b")], "src string, tgt string")
    symbols = frame(spark, [("b", f"s{i}", None, i, True) for i in range(20)] + [("b", "hidden", None, 0, False)], "file string, name string, signature string, line int, exported boolean")
    rows = context.skeleton(files, edges, symbols, 200, most=3).collect()
    assert [(r.id, r.in_degree, r.out_degree) for r in rows] == [("b", 3, 1), ("c", 2, 1), ("a", 0, 2), ("d", 0, 1)]
    assert rows[0].line.endswith("s2 +17")
    assert context.skeleton(files, edges, symbols, 1).count() == 0


def test_similarity_by_hand():
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert similarity.name_similarity("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert similarity.name_similarity("", "x") == 0.0
    assert similarity.path_similarity("src/a/x.ts", "src/b/x.ts") == pytest.approx(0.4 + 0.35 / 3 + 0.15 + 0.1)
    assert similarity.path_similarity(None, "x") == 0.0
    assert similarity.signature_similarity('{"isAsync":true,"parameters":[1,2]}', '{"isAsync":true,"parameters":[1]}') == pytest.approx(0.45)
    assert similarity.signature_similarity(None, "{}") == 0.5


def test_moved_elements_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 2)
    rows = [(f"e{i}", n, f, None) for i, (n, f) in enumerate([("parseFile", "src/a.ts"), ("parseFiles", "src/b.ts"), ("parse", "lib/a.ts"), ("render", "src/a.ts"), ("parseFile", "test/a.ts")])]
    df = frame(spark, rows, "id string, name string, file string, signature string")
    got = {(r.source, r.id): r.similarity for r in match.similar_elements(df, df, 0.7).collect()}
    for a in rows:
        for b in rows:
            s = similarity.combined(similarity.name_similarity(a[1], b[1]), similarity.path_similarity(a[2], b[2]), 0.5)[0]
            assert ((a[0], b[0]) in got) == (a[0] != b[0] and s >= 0.7)
    assert max(r["rank"] for r in match.moved(df, df, 0.7, 1).collect()) == 1


def test_vector_store(spark, tmp_path):
    store = vectors.VectorStore(spark, str(tmp_path / "s"))
    rows = frame(spark, [("a", [1.0, 0.0], {"k": "x"}, None), ("b", [1.0, 1.0], {"k": "y"}, None), ("c", [0.0, 0.0], {"k": "x"}, None)], vectors.SCHEMA)
    store.upsert(rows)
    assert [(r.id, round(r.score, 4)) for r in store.query([1.0, 0.0], 2).collect()] == [("a", 1.0), ("b", 0.7071)]
    assert [r.id for r in store.query([1.0, 0.0], wanted={"k": "x"}, least=0.5).collect()] == ["a"]
    with pytest.raises(ValueError, match="dimensions"):
        store.query([1.0])
    with pytest.raises(ValueError, match="lengths"):
        store.upsert(frame(spark, [("z", [1.0], {}, None)], vectors.SCHEMA))
    store.delete(["a"])
    assert store.fetch(["a", "b"]).count() == 1
    store.clear()
    assert store.all().count() == 0


def test_graph_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","name":"A","type":"f","file":"x","line":1}],"edges":[{"id":"e","sourceId":"a","targetId":"b","relationship":"call","resolutionStatus":"resolved","evidence":{"testOrigin":true},"sourceLocation":{"file":"x","line":3}}]}')
    nodes, edges = artifacts.load_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().name == "A"
    e = edges.first()
    assert (e.src, e.tgt, e.rel, e.status, e.line, e.test_origin) == ("a", "b", "call", "resolved", 3, True)
    with pytest.raises(ValueError, match="mode"):
        artifacts.sync_registry(nodes, nodes, "other")


def test_runs():
    assert jobs.index_gate(True, 40, 50) == ("warned", "header coverage 40% is below 50%")
    assert jobs.index_gate(True, 40, 50, strict=True)[0] == "refused"
    assert jobs.index_gate(False)[0] == "refused"
    with pytest.raises(ValueError, match="required"):
        jobs.index_gate(None)
    with pytest.raises(ValueError, match="one name"):
        jobs.run_phases([jobs.Step("a", dict), jobs.Step("a", dict)], {})
    sinks = jobs.Generators({"a": None, "b": None})
    assert sinks.chosen(skip=["a"]) == ["b"]
    with pytest.raises(ValueError, match="unknown"):
        sinks.chosen(["c"])
    now = [0.0]
    cache = jobs.TimedCache(10, 2, clock=lambda: now[0])
    for k in "aba":
        cache.get(k, lambda: k)
    cache.get("c", lambda: 1)
    assert list(cache.held) == ["a", "c"]
    now[0] = 10
    assert cache.expire() == 2
