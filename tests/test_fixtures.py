"""Hand-made cases of the scalar, diff, tree, grouping, graph and ranking operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import diff, trees
from patchloom.functions import text as T
from patchloom.functions import vectors as V
from patchloom.operators import clustering, graph, patterns, ranking, taxonomy, vector_search
from patchloom.plans import models
from patchloom.session import written
from patchloom.sources import readers, sinks

N = trees.Node


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(column.alias("r")).first()["r"]


def test_hunks(spark):
    def got(header):
        return tuple(one(spark, c, h=header) for c in T.hunk_lines(F.col("h")))

    assert got("@@ -3,2 +3,1 @@") == ([3, 4], [], [3])
    assert got("@@ -5,2 +4,0 @@") == ([], [5, 6], [])
    assert got("@@ -4,0 +5 @@") == ([], [], [5])


def test_changed_lines():
    assert diff.changed_lines("", "a\nb\nc") == ([], [], [1, 2, 3])
    assert diff.changed_lines("", "") == diff.changed_lines("a\nb", "a\nb") == ([], [], [])
    assert diff.changed_lines("a\nb\nc", "a\nX\nc\nd") == ([2], [], [2, 4])
    assert diff.line_map("a\nb\nc", "x\na\nc") == {1: 2, 3: 3}


def test_insertion_point():
    assert [diff.insertion_point("a\nb\nc", x) for x in ("a\nx\nb\nc", "x\na\nb\nc", "a\nb\nc\nx")] == [[1, 2], [1], [3]]


def test_myers_is_longest():
    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = diff.myers(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert len(pairs) == table[-1, -1]


def test_unified():
    assert "-b" in diff.unified("a\nb\nc", "a\nx\nc") and "\n\n" in diff.unified("a\nb\n", "a\nx\n", doubled=True)
    assert diff.diff_context("--- a\n+++ b\n@@ -1 +1 @@\n x\n-b\n+c\n y\n z") == [" x", "-b", "+c", " y"]


def test_lines(spark):
    assert one(spark, T.number_lines(F.col("t")), t="x\ny") == "1 | x\n2 | y"
    assert one(spark, T.number_lines(F.col("t"), 3), t="x\ny") == "  1 | x\n  2 | y"
    assert one(spark, T.number_lines(F.col("t")), t="  ") == "  "
    assert one(spark, T.pick_lines(F.col("t"), F.array(*map(F.lit, (3, 1, 3, 9)))), t="a\nb\nc") == "1: a\n3: c"
    assert one(spark, T.collapse_blank_lines(F.col("t")), t="a\n\n\n \nb") == "a\n\nb"


def test_sections(spark):
    full = "CWE-Specific Repair Strategy: a\nPre-Repair State: b\nAbstract Repair Strategy: c\nConcrete Repair Strategy: d\nPost-Repair State: e"
    status = lambda t: one(spark, T.labelled_sections(F.col("t"))["status"], t=t)
    assert [status(full), status("Pre-Repair State: x"), status("none")] == ["success", "partial", "failed"]
    right, feedback = T.verdict(F.col("t"), "default")
    assert one(spark, right, t="Result: incorrect") is False and one(spark, feedback, t="Result: incorrect") == "default"
    entries = T.valid_line_numbers(T.json_in_prose(F.col("t")), "array<struct<name:string,lines:array<string>>>")
    assert one(spark, entries, t='so ```json [{"name": "a", "lines": [3, -1, "x", 3]}] ```') == [3]


def test_vectors(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [1.0, 1.0], "a"), (3, [5.0, 5.0], "b")], "vec_id long, embedding array<float>, partition string")
    queries = spark.createDataFrame([(7, [0.0, 0.0], "a"), (8, [0.0, 0.0], "zzz")], "query_id long, query array<float>, key string")
    got = [(r.query_id, r.vec_id, r.distance) for r in vector_search.search(queries, base, 5).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1.0), (7, 2, 2.0), (8, 1, 1.0), (8, 2, 2.0), (8, 3, 50.0)]
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(V.squared_l2(F.col("a"), F.col("b"))).collect()
    texts = spark.createDataFrame([("some words",), ("  ",), (None,)], "t string")
    made = [r[0] for r in texts.select(V.embed(V.HashingEmbedder(8))(F.col("t"))).collect()]
    assert math.isclose(sum(x * x for x in made[0]), 1, rel_tol=1e-6) and not any(made[1]) and not any(made[2])


def test_ranking(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.4, 0), (1, 1.0, -2.0, 1), (1, 1.0, 999.0, 2), (1, 0.0, 0.1, 3)], "k int, score double, distance double, o int")
    assert [r.distance for r in ranking.select_top(rows, ["k"], 2, "o").orderBy("rank").collect()] == [-2.0, 0.4]
    judged = spark.createDataFrame([("High", 0.5), ("Medium", 0.6), ("Low", 0.9), ("Missing", 1.0)], "level string, confidence double")
    assert [tuple(r) for r in ranking.consistent(judged, "level", "confidence", "Medium", 0.6).collect()] == [("Medium", 0.6)]
    votes = spark.createDataFrame([(0, 1), (3, 5)], "yes int, n int").select(ranking.majority(F.col("yes"), F.col("n"), 0.6)).collect()
    assert [r[0] for r in votes] == [False, True]


EDGES = [(1, 1, 2, "data"), (1, 2, 3, "data"), (1, 3, 1, "control"), (1, 3, 4, "data")]


@pytest.mark.parametrize("limit", [graph.GROUPED_EDGES, 0])
def test_slices(spark, limit):
    edges = spark.createDataFrame(EDGES, "grp int, src int, dst int, kind string")
    seed = lambda n: spark.createDataFrame([(1, n)], "grp int, node int")
    reach = lambda e, s: sorted(r.node for r in graph.reachable(e, s, limit).collect())
    assert reach(edges, seed(3)) == [1, 2, 3, 4] and reach(graph.inverted(edges), seed(3)) == [1, 2, 3]
    assert reach(edges, seed(9)) == [9] and reach(edges, seed(3).limit(0)) == []
    assert graph.slices(edges, seed(3), "combined").count() == 4 and graph.slices(edges, seed(3), "sideways").count() == 0


def test_hops_and_seeds(spark):
    path = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "grp int, src int, dst int")
    start = spark.createDataFrame([(1, 1)], "grp int, node int")
    nodes = lambda h, c=False: sorted(r.node for r in graph.hops(path, start, h, c).collect())
    assert (nodes(1), nodes(2), nodes(2, True)) == ([2], [1, 3], [2, 3])
    sizes = spark.createDataFrame([(1, 5), (2, 5)], "grp int, n_lines int")
    seeds = spark.createDataFrame([(1, 2), (1, 9), (2, 3)], "grp int, node int")
    assert [tuple(r) for r in graph.checked_seeds(seeds, sizes).collect()] == [(2, 3)]


def test_taxonomy(spark):
    edges = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("Z", "gone")], "node string, parent string")
    paths = taxonomy.closure(edges)
    assert {r.node: "<>".join(r.path) for r in paths.collect()} == {"A": "A", "B": "A<>B", "C": "A<>B<>C", "Z": "Z"}
    assert {r.node: r.n for r in taxonomy.subtree_counts(paths).collect()} == {"A": 3, "B": 2, "C": 1, "Z": 1}
    rows = spark.createDataFrame([("C",), ("nope",), (None,), ("CWE-189",)], "k string")
    got = [r.top_parent for r in taxonomy.route(rows, "k", paths, main=taxonomy.MAIN_CLASSES).orderBy("k").collect()]
    assert got == ["CWE-0", "A", "CWE-189", "CWE-0"]
    counts = spark.createDataFrame([("A", 200), ("B", 5), ("C", 7)], "class string, n long")
    parents = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B")], "class string, parent string")
    assert {r["class"]: r["final"] for r in taxonomy.roll_up_rare(counts, parents, 100).collect()} == {"A": "A", "B": "A", "C": "A"}


def test_grouping():
    assert clustering.groups(np.ones((1, 1))) == [[0]]
    assert clustering.groups(np.array([[1, 0.1], [0.1, 1]])) == [[0, 1]]
    s = np.array([[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1]])
    assert clustering.groups(s) == [[0, 1], [2, 3]]
    rng = np.random.default_rng(0)
    for n in range(2, 12):
        v = rng.standard_normal((n, 4))
        assert sorted(i for g in clustering.groups(clustering.cosine_matrix(v)) for i in g) == list(range(n))


def leaf(t, v):
    return N(t, v)


def test_tree_fixtures():
    f = lambda *c: N("call", "f", c)
    x, a, b = leaf("name", "x"), leaf("name", "a"), leaf("name", "b")
    assert trees.generalise(f(x, leaf("lit", "1")), f(x, leaf("lit", "2"))) == f(x, trees.hole(0, "lit"))
    assert trees.generalise(f(N("g", "g", (a,))), f(N("h", "h", (a,)))) == f(trees.hole(0))
    assert trees.generalise(f(a, a), f(b, b)) == f(trees.hole(0, "name"), trees.hole(0, "name"))
    p, q, s = leaf("p", "p"), leaf("q", "q"), leaf("s", "s")
    bound = trees.matches(N("blk", "", (trees.run_hole(0), s, trees.run_hole(1))), N("blk", "", (p, s, q, s)))[0][1]
    assert bound == {trees.run_hole(0).value: (p,), trees.run_hole(1).value: (q, s)}
    assert trees.unbound(f(trees.hole(0)), f(trees.hole(1))) and not trees.unbound(f(trees.hole(0)), f(trees.hole(0)))
    before, after = N("call", "", (trees.hole(0),)), N("if", "", (trees.hole(0), N("call", "", (trees.hole(0),))))
    assert trees.apply(before, after, N("call", "", (p,))) == [N("if", "", (p, N("call", "", (p,))))]
    assert trees.generalise_runs((a, b), (b,), trees.HoleTable(), True) == (trees.run_hole(0), b)
    assert trees.generalise_runs((a, b), (a,), trees.HoleTable(), False) == (a, trees.run_hole(0))


def random_tree(rng, depth):
    if not depth:
        return leaf("leaf", rng.choice("abc"))
    return N(rng.choice("fgh"), rng.choice("12"), tuple(random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))))


def test_tree_properties():
    rng = random.Random(0)
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        assert trees.generalise(a, a) == a
        for g in (trees.generalise(a, b), trees.generalise_stripped(trees.plain(a), trees.plain(b), trees.HoleTable())):
            assert all(trees.matches(g, x) and trees.matches(g, x)[0][0] == 0 for x in (a, b))
        assert trees.from_canonical(trees.canonical(a)) == a
        assert trees.build(trees.parse_text(trees.to_text(a))) == a
        script = trees.edit_script(a, b)
        assert len(set(script.mapping.values())) == len(script.mapping)
        for p in trees.extract(a, b, 0):
            assert trees.matches(p.before, a)


def test_strip_and_merge():
    k, m, x, y, z = (leaf("t", v) for v in "kmxyz")
    before, after = strip = trees.strip(N("c", "f", (k, x, m, k)), N("c", "f", (k, y, m, k)))
    assert [c.value for c in before.children] == ["x"] and before.runs == ((k,), (m, k)) and after.runs == ((k,), (m, k))
    assert tuple(map(trees.restored, strip)) == (N("c", "f", (k, x, m, k)), N("c", "f", (k, y, m, k)))
    # unequal runs: aligned to the kept child, the surplus is one run hole, the same on both sides
    p = trees.Pattern(N("c", "f", (m, k, x)), N("c", "f", (m, k, y)), (1,))
    q = trees.Pattern(N("c", "f", (k, x)), N("c", "f", (k, y)), (2,))
    got = trees.merge(p, q)
    assert got.before.children[1:] == (k, x) and got.after.children[1:] == (k, y) and trees.is_run(got.before.children[0]) and got.before.children[0] == got.after.children[0]
    assert trees.apply(got.before, got.after, N("c", "f", (z, z, k, x))) == [N("c", "f", (z, z, k, y))]
    assert trees.merge(p, p._replace(before=N("c", "f", (k, x)))) is None
    t = trees.traits(p)
    assert (t.modified, t.unmodified, t.labelled) == (2, 2, 2)
    refused = trees.dendrogram([p, q], gate=lambda a, b: False)
    assert len(refused) == 2 and len(trees.dendrogram([p, q])) == 3


def test_merged_patterns_rewrite_as_their_parts_do():
    rng = random.Random(3)
    merged = 0

    def edited():
        kids = [random_tree(rng, rng.randint(0, 1)) for _ in range(rng.randint(1, 4))]
        at = rng.randrange(len(kids))
        new = rng.choice([(N("wrap", "w", (kids[at],)),), (kids[at], leaf("leaf", "new")), ()])
        return N("c", "f", tuple(kids)), N("c", "f", (*kids[:at], *new, *kids[at + 1 :]))

    for _ in range(400):
        (a, b), (c, d) = edited(), edited()
        got = trees.merge(trees.Pattern(a, b, (1,)), trees.Pattern(c, d, (2,)))
        if got is not None:
            merged += 1
            for before, after in ((a, b), (c, d)):
                assert trees.matches(got.before, before) and (trees.matches(got.after, after) if got.after else after is None)
    assert merged > 10


def test_indexed_matches_as_matches_do():
    rng = random.Random(6)
    for _ in range(200):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        tree, truth = trees.Indexed(a), trees.Indexed(b)
        for p in trees.extract(a, b, 0):
            assert tree.matches(p.before) == trees.matches(p.before, a)
            for at, bound in tree.matches(p.before) if not trees.unbound(p.before, p.after) else []:
                new = trees.fill(p.after, bound) if p.after else ()
                made = trees.replace_at(a, at, new)
                assert tree.replaced(at, new) == made
                assert tree.reads_like(truth, at, new) == (made is not None and trees.to_code(made) == trees.to_code(b))


def test_script_marks():
    a = N("r", "", (leaf("x", "1"), N("y", "", (leaf("z", "2"), leaf("z", "3")))))
    b = N("r", "", (leaf("x", "1"), leaf("n", "new"), N("y", "", (leaf("z", "2"),))))
    s = trees.read_script(a, b, '{"matches": [{"src": 0, "dest": 0}, {"src": 1, "dest": 1}, {"src": 2, "dest": 3}, {"src": 3, "dest": 4}], "actions": [{"action": "insert-node", "tree": 2}, {"action": "delete-node", "tree": 4}]}')
    assert s.modified == {0, 2}


def test_script_and_budget():
    a, b = N("r", "", (leaf("x", "1"), N("y", "", (leaf("z", "2"),)))), N("r", "", (N("y", "", (leaf("z", "2"),)), leaf("x", "1")))
    s = trees.read_script(a, b, '{"matches": [{"src": 0, "dest": 0}, {"src": 2, "dest": 1}], "actions": [{"action": "move-tree", "tree": 2}, {"action": "delete-node", "tree": 1}]}')
    assert s.deleted == {1, 2, 3} and s.inserted == {1, 2}
    with pytest.raises(trees.Budget):
        trees.matches(N("r", "", tuple(trees.run_hole(i) for i in range(12)) + (leaf("q", ""),)), N("r", "", tuple(leaf("x", str(i)) for i in range(30))), steps=50)


def test_dendrogram_keeps_sources():
    ps = [trees.Pattern(N("c", "f", (leaf("a", str(i)), leaf("k", "k"))), None, (i,)) for i in range(5)] * 2
    out = trees.dendrogram(ps)
    assert len(out) == 9 and len(out[-1][3].sources) == 5 and trees.is_hole(out[-1][3].before.children[0])


def test_patterns_of_one_shape_are_merged_once(monkeypatch):
    # each node was compared with all others, and chains kept the sources of all their nodes
    ps = [trees.Pattern(N("title", "", (leaf("text", f"a{i}"),)), N("title", "", (leaf("text", "b"),)), (i,)) for i in range(300)]
    tried = []
    monkeypatch.setattr(trees, "merge", lambda *a, f=trees.merge: tried.append(1) or f(*a))
    out = trees.dendrogram(ps)
    assert len(tried) <= 3 and len(out) == 599 and sorted(out[-1][3].sources) == list(range(300))
    assert sum(len(p.sources) for *_, p in trees.grown(ps)) == 600
    # two leaves of one source do not merge with each other
    out = trees.dendrogram([p._replace(sources=(i // 2,)) for i, p in enumerate(ps)])
    assert all(out[left][3].sources != out[right][3].sources for _, left, right, _ in out if left is not None)
    # by brute force: of mixed shapes, each merge is of two that merge, with what that gives, and what is left has no partner
    rng = random.Random(2)
    words = lambda: tuple(leaf("text", rng.choice([*"abc", f"x{rng.random()}"])) for _ in range(rng.randint(1, 3)))
    ps = [trees.Pattern(N("p", "", words()), None if i % 3 else N("p", "", words()), (i // 2,)) for i in range(90)]
    out, open_ = trees.dendrogram(ps), {}
    for i, left, right, p in out:
        if left is not None:
            assert trees.merge(open_.pop(left), open_.pop(right)) == p
        open_[i] = p
    assert len(out) > 100 and not any(trees.merge(p, q) for i, p in open_.items() for j, q in open_.items() if i < j)


def test_feedback_loop(spark):
    class Second:
        def complete(self, task, inputs):
            if task == "verdict":
                return "Result: correct" if inputs["round"] == "2" else "Result: Incorrect\nFeedback: more"
            return '{"patch_diff": "x"}' if task == "apply" else "CWE-Specific Repair Strategy: plan"

    docs = spark.createDataFrame([(1, "code"), (2, " "), (3, None)], "k long, t string")
    got = {r.k: (r.attempts, r.status) for r in models.feedback_loop(docs, Second(), "k", "t").collect()}
    assert got == {1: (2, "success"), 2: (0, "failed"), 3: (0, "failed")}


def test_ask_waits_longer_each_time():
    class Fails:
        calls = 0

        def complete(self, task, inputs):
            self.calls += 1
            if self.calls % 2:
                raise models.ModelFailure("no")
            return ""

    m, waits = Fails(), []
    assert models.ask(m, "x", {}, sleep=waits.append) is None and m.calls == models.ATTEMPTS and waits == [5.0, 10.0]

    class Broken:
        def complete(self, task, inputs):
            raise KeyError(task)

    with pytest.raises(KeyError):
        models.ask(Broken(), "x", {})
    with pytest.raises(ValueError):
        models.backend("none")
    assert models.ask(models.backend("debug"), "x", {}) == "debug"


def test_backends(monkeypatch):
    import sys

    echo = models.Command([sys.executable, "-c", "import json, sys; x = json.load(sys.stdin); print(x['task'], x['inputs']['code'])"])
    assert echo.complete("judge", {"code": "a b"}) == "judge a b"
    with pytest.raises(models.ModelFailure):
        models.Command([sys.executable, "-c", "raise SystemExit(3)"]).complete("judge", {})
    guarded = models.Guarded(models.Constant("secret"), lambda x: "policy" if "secret" in x else None)
    assert guarded.complete("t", {}) == "" and models.Guarded(models.Constant("fine"), lambda x: None).complete("t", {}) == "fine"
    assert len(models.samples(models.StandIn(), "explain", {"code": "x"}, 4)) == 4
    monkeypatch.setenv("SOME_API_KEY", "k")
    assert models.credential("some") == "k" and models.credential("some", "own") == "own"
    with pytest.raises(ValueError):
        models.credential("nobody")


def test_slicing_command(spark, tmp_path):
    from patchloom import slice as slicing

    (tmp_path / "n.csv").write_text("key\ttype\tcode\tlocation\n1\tS\ta\t1:0\n2\tS\tb\t2:0\n3\tS\tc\t3:0\n")
    (tmp_path / "e.csv").write_text("start\tend\ttype\tvar\n1\t2\tREACHES\tv\n2\t3\tFLOWS_TO\t\n")
    (tmp_path / "s.c").write_text("a = 1; // one\nb = a;\nc();\n")
    where = [f"file://{tmp_path}/{x}" for x in ("n.csv", "e.csv", "s.c", "out")]
    got = {r.part: r.text for r in slicing.write_slices(spark, *where, [2]).collect()}
    assert got["forward"] == "b = a;\nc();" and got["backward"] == "a = 1;\nb = a;" and "blue" in got["dot"] and "red" in got["dot"]
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"part=forward", "part=backward", "part=dot"}
    assert slicing.write_slices(spark, *where, [9]).where("part <> 'dot'").count() == 0


def test_cycles_are_an_error(spark):
    edges = spark.createDataFrame([("A", None), ("B", "A"), ("X", "Y"), ("Y", "X")], "node string, parent string")
    with pytest.raises(taxonomy.CycleError):
        taxonomy.closure(edges)


def test_sources(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "v.csv").write_text('﻿code_before,code_after,CWE ID\n"a\nb ""q""",c,CWE-1\n')
    got = readers.read_vulnerabilities(spark, f"{path}/v.csv").first()
    assert got.code_before == 'a\nb "q"' and got.trigger_path is None
    with pytest.raises(readers.MissingColumns):
        readers.read_fix_pairs(spark, f"{path}/v.csv")
    (tmp_path / "p.csv").write_text("a,b\nc,d\ne,f\n")
    assert readers.read_positional(spark, f"{path}/p.csv", last_index=1).count() == 2
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"y": "z"}')
    both = readers.read_json_records(spark, [f"{path}/a.json", f"{path}/none.json", f"{path}/b.json"])
    assert both.count() == 3 and set(both.columns) == {"x", "y"}
    (tmp_path / "n.csv").write_text("key\ttype\tcode\tidentifier\tlocation\tfunctionId\tchildNum\n1\tF\tx\tn\t7:1\t1\t0\n2\tG\ty\tm\t\t1\t1\n")
    (tmp_path / "e.csv").write_text("start\tend\ttype\tvar\n1\t2\tREACHING_DEF\t\n1\t2\tFLOWS_TO\t\n")
    nodes, edges = readers.read_graph(spark, f"{path}/n.csv", f"{path}/e.csv")
    assert [r.line for r in nodes.orderBy("id").collect()] == [7, None] and edges.count() == 1
    (tmp_path / "s.c").write_text("int a; // one\n  b();\n")
    assert [tuple(r)[1:] for r in readers.read_source_lines(spark, f"{path}/s.c").orderBy("line").collect()] == [(1, "int a;"), (2, "b();")]
    assert readers.random_vectors(spark, 5, 3).count() == 5
    rows = spark.createDataFrame([("a/b", 1, "t1"), ("c", 0, "t2"), (None, 2, "t3")], "p string, hits int, t string").withColumn("exact", F.lit(False))
    sinks.write_by_parent(rows, "p", f"{path}/out")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == ["part=a_b", "part=c"]
    sinks.write_hits(rows, f"{path}/hits")
    assert spark.read.option("header", True).csv(f"{path}/hits").count() == 2
    sinks.write_results(rows, rows.select("p"), f"{path}/results")
    sinks.write_lines(rows, f"{path}/lines")
    sinks.write_texts(rows.where("p IS NOT NULL"), "p", "t", f"{path}/texts")
    assert spark.read.json(f"{path}/results/summary").count() == spark.read.json(f"{path}/lines").count() == 3


def test_first_declaration_and_parallel(spark):
    names = spark.createDataFrame([(1, "x", 2)], "grp int, name string, block_line int")
    text = spark.createDataFrame([(1, 1, "int x;"), (1, 3, "int x;"), (1, 4, "x = 1")], "grp int, line int, text string")
    assert graph.first_declaration(names, text).first().line == 3
    edges = spark.createDataFrame([(1, 1, 2, "control", 0), (1, 1, 2, "data", 1)], "grp int, src int, dst int, kind string, o int")
    assert graph.last_parallel(edges, "o").first().kind == "data"


def test_pattern_frames(spark):
    pages = spark.createDataFrame([(i, f"<ul>{'<li>x</li>' * (i % 3 + 1)}</ul><p>t{i}") for i in range(6)], "page_id long, html string")
    pairs = patterns.consecutive(patterns.parse_pages(pages))
    assert pairs.count() == 5
    mined = patterns.mine(pairs)
    assert mined.count() > 0 and patterns.clustered(mined, block=2).count() >= mined.select("root_type", "before", "after").distinct().count()


def test_patterns_of_wide_pages_apply(spark):
    # a match looked at each sibling in a call of its own; with 1,500 of them that was too deep
    wide = ["<ul>" + "".join(f"<li>{x}{i}</li>" for i in range(1200)) + "</ul>" for x in "ab"]
    pages = spark.createDataFrame(list(enumerate(wide)), "page_id long, html string")
    got = patterns.mined_and_applied(patterns.consecutive(patterns.parse_pages(pages))).collect()
    # the list, its elements and their texts; the list alone rewrites to the next page
    assert len(got) == 2401 and all(r.complete and r.hits == 1 for r in got) and [r.pattern_no for r in got if r.exact] == [0]
    ul = N("ul", "", tuple(leaf("li", str(i)) for i in range(3000)))
    assert [i for i, _ in trees.matches(ul, ul)] == [0]
    before = N("ul", "", (trees.run_hole(0), leaf("li", "2990"), trees.run_hole(1), leaf("li", "2999")))
    ((at, bound),) = trees.matches(before, ul)
    assert at == 0 and len(bound[trees.run_hole(0).value]) == 2990 and len(bound[trees.run_hole(1).value]) == 8


def test_clustered_takes_whole_root_types(spark):
    rows = [("p", i, trees.Pattern(N("p", "v" if i % 5 else "w", (leaf("a", str(i)), leaf("k", "k"))), leaf("p", "z") if i % 3 else None, (i,))) for i in range(30)]
    frame = spark.createDataFrame([(t, i, trees.canonical(p.before), trees.canonical(p.after), p.size()) for t, i, p in rows], "root_type string, pair_id long, before string, after string, size long")
    got = patterns.clustered(frame, block=2).collect()
    assert len({(r.block, r.node) for r in got}) == len(got)
    taken = {(r.block, x) for r in got for x in (r.left, r.right) if x >= 0}
    assert taken <= {(r.block, r.node) for r in got}
    # four kinds, each of them one dendrogram, whose root says the same however many rounds it took
    want = trees.dendrogram([p for _, _, p in rows])
    below = {x for _, left, right, _ in want for x in (left, right)}
    tops = sorted((trees.canonical(p.before), trees.canonical(p.after), len(p.sources)) for i, _, _, p in want if i not in below)
    assert sorted((r.before, r.after, r.sources) for r in got if (r.block, r.node) not in taken) == tops and len(tops) == 4
    assert sum(r.left >= 0 for r in got) == 26 and max(r.sources for r in got) == 16


def test_after_labels_rule_out_what_does_not_merge():
    texts = [N("p", "", tuple(leaf("t", x) for x in xs)) for xs in ("a", "b", "ab", "bc", "abc", "cab", "")]
    texts += [N("p", "", (N("q", "", t.children),)) for t in texts]
    ps = [trees.Pattern(b, a, (i,)) for i, (b, a) in enumerate((b, a) for b in texts for a in texts if a != b)]
    merged = 0
    for p in ps:
        own, every = trees.after_labels(p)
        for q in ps:
            if p is not q and trees.merge(p, q) is not None:
                merged += 1
                assert own <= trees.after_labels(q)[1] and trees.after_labels(q)[0] <= every
    assert merged > 100


def test_only_what_may_merge_is_clustered_together(spark):
    # a kind was one task; now a part holds all that may ever merge, and what has no partner is in none
    texts = [N("p", "", tuple(leaf("t", x) for x in xs)) for xs in ("a", "b", "ab", "bc", "abc", '["')]
    some = [trees.Pattern(b, a, (i,)) for i, (b, a) in enumerate((b, a) for b in texts for a in texts if a != b)]
    apart = [trees.Pattern(N("p", "", (leaf("t", f"x{i}"),)), N("p", "", (leaf("t", f"y{i}"),)), (100 + i,)) for i in range(50)]
    copies = [trees.Pattern(N("p", "", (leaf("t", f"x{i}"),)), N("p", "", (leaf("t", "z"),)), (200 + i,)) for i in range(50)]
    ps = some + apart + copies
    frame = spark.createDataFrame([("p", p.sources[0], trees.canonical(p.before), trees.canonical(p.after), p.size()) for p in ps], "root_type string, pair_id long, before string, after string, size long")
    part = {r.first: r.part for r in patterns._linked(patterns._facts(frame)).collect()}
    assert all(part[p.sources[0]] is None for p in apart) and len({part[p.sources[0]] for p in copies}) == 1 and part[200] is not None
    linked = [(p, q) for p in ps for q in ps if p is not q and trees.merge(p, q) is not None]
    assert len(linked) > 2450 and all(part[p.sources[0]] == part[q.sources[0]] is not None for p, q in linked)
    got = patterns.clustered(frame, text=False)
    assert got.columns == ["root_type", "block", "node", "left", "right", "size", "sources"]
    below = lambda out: sum(left is not None for _, left, *_ in out)
    assert got.where("left >= 0").count() == below(trees.dendrogram(ps)) and got.count() == len(trees.dendrogram(ps))


def test_node_hits_and_hierarchical_apply(spark, tmp_path):
    from patchloom.operators import dendrogram
    from patchloom.plans import change_queries

    html = [f"<ul><li>k</li><li>{w}</li></ul><p>a{i % 4}</p><p>z</p>" + "<p>a1</p>" * (i % 4) for i, w in enumerate(["x", "y", "x", "v", "x", "w", "y", "y"])]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    parsed = patterns.parse_pages(pages)
    nodes = patterns.clustered(patterns.mine(patterns.consecutive(parsed))).withColumn("tree", F.concat_ws("/", "root_type", "block")).cache()
    level = {(r.tree, r.node): (r.path[0], r.level) for r in dendrogram.paths(nodes.select("tree", "node", "left", "right")).collect()}
    best = {}
    for n in nodes.collect():
        root, depth = level[n.tree, n.node]
        for t in parsed.collect():
            made = trees.apply(trees.from_canonical(n.before), trees.from_canonical(n.after), trees.from_canonical(t.tree))
            if made:
                best.setdefault((t.tree_id, f"{n.tree}/{root}"), []).append((depth, n.node, len(made)))
    want = {(*k, node, depth, m) for k, v in best.items() for depth, node, m in v if depth == max(v)[0] and m <= 2}
    got = change_queries.hierarchical_apply(spark, f"file://{tmp_path}").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
    assert any(m > 2 for v in best.values() for *_, m in v) and len({r.target for r in got}) > 1


def test_levels_of_a_chain_take_few_steps(spark, monkeypatch):
    # paths went level by level, and chains of check_s have over 1,000 levels
    from patchloom.operators import dendrogram

    n, steps = 300, []
    chain = [("t", i, -1, -1) for i in range(n + 1)] + [("t", n + 1, 0, 1)] + [("t", n + i, n + i - 1, i) for i in range(2, n + 1)]
    nodes = spark.createDataFrame([*chain, ("u", 5, -1, -1)], "tree string, node int, left int, right int")
    monkeypatch.setattr(dendrogram, "written", lambda df, name: steps.append(name) or written(df, name))
    got = {(r.tree, r.node): (r.level, r.root) for r in dendrogram.levels(nodes).collect()}
    want = {("t", n + i): (n - i, 2 * n) for i in range(1, n + 1)} | {("t", i): (n - max(i, 1) + 1, 2 * n) for i in range(n + 1)} | {("u", 5): (0, 5)}
    assert got == want and len(steps) <= 12


def test_levels_and_leaves_of_a_chain_take_few_steps(spark, monkeypatch):
    # dendrogram_traversal wrote a path for each node, level by level
    from patchloom.operators import dendrogram
    from patchloom.plans import change_queries

    n, steps, rng = 300, [], random.Random(5)
    rows = [("t", i, -1, -1) for i in range(n + 1)] + [("t", n + 1, 0, 1)] + [("t", n + i, n + i - 1, i) for i in range(2, n + 1)] + [("u", 5, -1, -1)]
    for tree in "vwxy":
        top, tip = list(range(40)), 40
        rows += [(tree, i, -1, -1) for i in top]
        while len(top) > 3:
            left, right = (top.pop(rng.randrange(len(top))) for _ in range(2))
            rows.append((tree, tip, left, right))
            top, tip = [*top, tip], tip + 1
    nodes = spark.createDataFrame(rows, "tree string, node long, left long, right long")
    small = nodes.where("tree <> 't'")
    found = dendrogram.paths(small)
    tips = {(r.tree, r.node): r["count"] for r in dendrogram.leaves(small, found).groupBy("tree", "node").count().collect()}
    want = {(r.tree, r.node, r.level, tips[r.tree, r.node]) for r in found.collect()}
    want |= {("t", n + i, n - i, i + 1) for i in range(1, n + 1)} | {("t", i, n - max(i, 1) + 1, 1) for i in range(n + 1)}
    monkeypatch.setattr(dendrogram, "written", lambda df, name: steps.append(name) or written(df, name))
    monkeypatch.setattr(change_queries, "_dendrogram", lambda spark, d: nodes)
    got = [tuple(r) for r in change_queries.dendrogram_traversal(spark, "").collect()]
    assert len(got) == len(rows) and set(got) == want and len(steps) <= 13


def test_left_sides_are_matched_once_and_deepest_hits_found_in_groups(spark, monkeypatch):
    # every node was matched against every target with its label, whatever else had the same left side
    texts = [N("p", "", (leaf("t", x),)) for x in ("a", 'say "!@#$hole', "\u00fc\n")]
    lefts = [*texts, leaf("t", "a"), N("p", "", (trees.hole(1000, "t"),)), N("ul", "", (trees.run_hole(1000), texts[0])), N("ul", "", (leaf("li", "nowhere"), trees.run_hole(1000)))]
    pages = [N("ul", "", tuple(texts[j % 3] for j in range(i))) for i in range(7)]
    assert all(sorted(trees.subtree_texts(p)) == sorted(map(trees.canonical, trees.nodes(p))) for p in [*pages, *lefts])
    targets = spark.createDataFrame([(i, trees.canonical(p)) for i, p in enumerate(pages)], "target long, page string")
    side = spark.createDataFrame([(i, trees.canonical(x)) for i, x in enumerate(lefts)], "i int, before string").withColumn("left_id", patterns._digest("before"))
    hits = written(patterns.left_hits(side.select("before").unionByName(side.select("before")), side.select("left_id"), targets), "hits")
    found = [(r.target, r.i, r.matches) for r in hits.join(side, "left_id").collect()]
    brute = {(t, i, len(m)) for t, page in enumerate(pages) for i, x in enumerate(lefts) if (m := trees.matches(x, page))}
    assert set(found) == brute and len(found) == len(brute) > 20
    # kinds, trees and levels of nodes with these left sides: shared levels, one left side at several levels, kinds of one tree
    placed = [(f"k{n % 3}", f"k{n % 3}/{n % 5}", n, n // 7 % 4, i) for n, i in enumerate(list(range(7)) * 9)]
    frame = spark.createDataFrame(placed, "kind string, tree string, node long, level int, i int").join(side.select("i", "left_id"), "i").drop("i")
    rows = [(t, tree, node, level, m) for t, i, m in brute for _, tree, node, level, j in placed if i == j]
    deepest = {(t, tree): max(r[3] for r in rows if r[:2] == (t, tree)) for t, tree, *_ in rows}
    want = {r for r in rows if r[3] == deepest[r[:2]] and r[4] <= 2}
    for cells in (1 << 20, 40, 4):
        monkeypatch.setattr(patterns, "_CELLS", cells)
        got = [tuple(r) for r in patterns.deepest_hits(frame, hits, 2).collect()]
        assert set(got) == want and len(got) == len(want) > 20


def test_stream_windows(spark, tmp_path):
    from patchloom.streaming import changes

    events = spark.createDataFrame([(i, i % 2) for i in range(10)], "i long, k long").withColumn("ts", F.timestamp_seconds(F.col("i") * 1800))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = changes.windowed_counts(changes.changes(spark, f"file://{tmp_path}/in", "i long, k long, ts timestamp"), "ts", "k")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").groupBy().sum("n").first()[0] == 8


def test_dendrogram_traversal(spark):
    from patchloom.operators import dendrogram

    nodes = spark.createDataFrame([("t", 0, -1, -1), ("t", 1, -1, -1), ("t", 2, -1, -1), ("t", 3, 0, 1), ("t", 4, 2, 3), ("u", 0, -1, -1)], "tree string, node int, left int, right int")
    found = dendrogram.paths(nodes)
    got = {(r.tree, r.node): r.path for r in found.collect()}
    assert got["t", 0] == [4, 3, 0] and got["t", 2] == [4, 2] and got["u", 0] == [0]
    tips = {(r.tree, r.node): 0 for r in dendrogram.leaves(nodes, found).collect()}
    assert ("t", 3) in tips and dendrogram.leaves(nodes, found).where("node = 4").count() == 3
    hits = found.select(F.lit(1).alias("target"), "tree", "node", "level")
    assert {r.node for r in dendrogram.deepest_hits(hits.where("tree = 't'")).collect()} == {0, 1}
    flat = spark.createDataFrame([(0,), (7,)], "node int")
    assert [r.node for r in dendrogram.outside_trees(flat, nodes, "node").collect()] == [7]
    marked = found.withColumns({"up": F.lit(4), "low": F.lit(0)})
    assert dendrogram.is_ancestor(marked, "up", "low").where("tree = 't'").count() == 1


def test_c_text():
    name = lambda v: leaf("name", v)
    call = N("expr_stmt", "", (N("expr", "", (N("call", "", (name("f"), N("argument_list", "", (name("a"), name("b"))))),)),))
    tree = N("if", "", (N("condition", "", (name("x"), leaf("operator", ">"), leaf("literal", "0"))), N("block", "", (call, leaf("break", "")))))
    assert trees.to_c(tree) == "if (x > 0) {\n    f(a, b);\n    break;\n}"
