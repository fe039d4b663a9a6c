"""Reference operators: worked cases, brute force and invariants."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import curate, dedup, graph, metrics, prompts, render, similarity
from quarrymill.plans.storage import ship
from quarrymill.sources import files


def one(spark, *values, **columns):
    """The values of Column expressions over one row of columns."""
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
    return list(df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).first())


@pytest.mark.parametrize(
    "code, language, expected",
    [
        ("/* lic */\n\nint x;\n// t", "C", "\nint x;\n// t"),
        ("// a\nint x;", "C", "\n"),
        ("#!/bin/sh\nimport os", "Python", "#!/bin/sh\nimport os"),
        ("#!/bin/sh", "Python", "#!/bin/sh"),
        ("x = 1", "Python", "\nx = 1"),
        ("<?php\n// a\nb", "PHP", "\n<?php\n// a\nb"),
        ("anything", "Cobol", "anything"),
    ],
)
def test_leading_comments(spark, code, language, expected):
    assert one(spark, T.strip_leading_comments(F.col("c"), F.col("l")), c=code, l=language) == [expected]


def test_single_line_comments(spark):
    assert one(spark, T.strip_leading_comments(F.col("c"), F.lit("C"), line_comments="single"), c="// a\n/* b */ int x;") == ["\nint x;"]


def test_text(spark):
    assert one(spark, T.tokens(F.col("c")), c="Foo_bar  Baz9!")[0] == ["foo", "bar", "baz9"]
    assert one(spark, T.split_repo_url(F.lit("https://h/o/r:abc")))[0] == ("https://h/o/r", "abc", "o", "r")
    assert one(spark, T.split_repo_url(F.lit("https://h/o/r")))[0] == ("https://h/o/r", None, "o", "r")
    tagged = T.tagged_output(F.col("c"))
    assert one(spark, tagged, c="<candidates>a</candidates><final_output> b </final_output>") == ["b"]
    assert one(spark, tagged, c="<candidates>a</candidates><final_output> b ") == [None]
    assert one(spark, tagged, c="<candidates>a</candidates><final_output>  </final_output>") == [None]
    assert one(spark, T.null_to_none(F.lit("null nullable 'null'"))) == ["None nullable 'None'"]
    assert one(spark, T.on_keyboard(F.lit("a b\n{}一")), T.on_keyboard(F.lit("é"))) == [True, False]
    assert one(spark, T.joined_fields(F.lit("a"), F.lit("b")), T.joined_fields(F.lit("a"), F.lit(" "))) == ["a\nb", None]
    with pytest.raises(ValueError):
        T.joined_fields(F.lit("a"), F.lit("b"), F.lit("c"))


def test_dominant(spark):
    kind = "array<struct<name:string,size:bigint>>"
    rows = [([("A", 50), ("B", 30), ("C", 20)],), ([("A", 60), ("B", 40)],), ([],), ([("A", 0)],)]
    got = spark.createDataFrame(rows, f"x {kind}").select(curate.dominant(F.col("x"))).collect()
    assert [r[0] for r in got] == [["A", "B"], ["A"], [], []]


def test_samples(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 70, "a").otherwise("b").alias("s"))
    assert Counter(r["s"] for r in curate.quota_sample(df, "s", "id", 10, 1).collect()) == {"a": 7, "b": 3}
    assert Counter(r["s"] for r in curate.capped_sample(df, ["s"], "id", 40, 1).collect()) == {"a": 40, "b": 30}
    first = [r["id"] for r in curate.shuffled(df, "id", 3).collect()]
    assert first == [r["id"] for r in curate.shuffled(df, "id", 3).collect()] != list(range(100))
    cap = curate.priority_cap(100000, F.col("s"), 12, ["a", "x", "y", "z", "u", "v"])
    assert [r[0] for r in df.select(cap.alias("c")).distinct().orderBy("c").collect()] == [4166, 12499]


@pytest.mark.parametrize("measure", list(similarity.MEASURES))
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similarity_is_brute_force(spark, measure, threshold):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    reps = similarity.representatives(spark.createDataFrame(docs, "id bigint, text string"), "id", "text")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.all_pairs(reps, measure, threshold).collect()}
    bags = {r["id"]: Counter(r["bag"]) for r in reps.collect()}
    score = {"jaccard": lambda o, a, b: o / (a + b - o), "cosine": lambda o, a, b: o / math.sqrt(a * b), "containment_min": lambda o, a, b: o / max(a, b), "containment": lambda o, a, b: o / a}[measure]
    want = {}
    for i, x in bags.items():
        for j, y in bags.items():
            if i > j or measure == "containment" and i != j:
                s = score(sum((x & y).values()), sum(x.values()), sum(y.values()))
                if s >= threshold * (1 - 1e-9):
                    want[i, j] = s
    assert got == pytest.approx(want)


def test_similarity_arguments(spark):
    reps = spark.createDataFrame([(1, ["a"])], "id bigint, bag array<string>")
    for bad in (("overlap", 0.5), ("jaccard", 1), ("jaccard", 0.0), ("jaccard", 1.5)):
        with pytest.raises(ValueError):
            similarity.all_pairs(reps, *bad)


def test_worked_example(spark):
    docs = spark.createDataFrame([(1, "t0 t0 t1 t2"), (2, "t0 t1 t1")], "id bigint, text string")
    reps = similarity.representatives(docs, "id", "text")
    value = lambda m: {(r[0], r[1]): r[2] for r in similarity.all_pairs(reps, m, 0.1).collect()}
    assert value("jaccard")[2, 1] == pytest.approx(0.4)
    assert value("cosine")[2, 1] == pytest.approx(1 / math.sqrt(3))
    assert value("containment_min")[2, 1] == 0.5
    assert value("containment") == {(1, 2): 0.5, (2, 1): pytest.approx(2 / 3)}


def test_similarity_moves_no_sets(spark, monkeypatch):
    """Sets are stored once, and no shuffle carries them or candidates; small blocks and chunks give the same pairs."""
    rng = random.Random(8)
    near = [" ".join(sorted(rng.sample([f"w{k}" for k in range(200)], 190))) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate([*near, *near[:5], "w1", "w1 W2", "\u0130x \u212a", "i x k", "a" * 150, "a" * 151, "", None])], "id bigint, text string").repartition(3)
    reps = similarity.representatives(docs, "id", "text")
    bags = {r["id"]: Counter(r["bag"]) for r in reps.collect()}
    for name, value in (("LEAST", 400), ("MOST", 500), ("AT_ONCE", 64), ("RUN", 2)):
        monkeypatch.setattr(similarity, name, value)
    plans = []
    monkeypatch.setattr(similarity, "cut", lambda df, cut=similarity.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    for measure, score in (("jaccard", lambda o, a, b: o / (a + b - o)), ("containment", lambda o, a, b: o / a)):
        want = {}
        for i, x in bags.items():
            for j, y in bags.items():
                s = score(sum((x & y).values()), sum(x.values()), sum(y.values()))
                if (i > j or measure == "containment" and i != j) and s >= 0.9 * (1 - 1e-9):
                    want[i, j] = s
        assert len(want) > 20
        got = similarity.document_pairs(docs, "id", "text", measure, 0.9).collect()
        assert {(r[0], r[1]): r[2] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert sum("CartesianProduct" in p for p in plans) == 2


@pytest.mark.parametrize("measure", ["cosine", "containment"])
def test_similarity_links_members(spark, tmp_path, measure):
    """No link between different texts is lost: those with equal bags are linked to their representative."""
    from quarrymill.plans import registry

    docs = [(1, "a b c"), (2, "C, b a"), (3, "c b; a"), (4, "x"), (5, ""), (6, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    links = {tuple(r) for r in registry.QUERIES[f"sim_{measure}"](spark, str(tmp_path)).collect()}
    back = {(1, 2, 1.0), (1, 3, 1.0)} if measure == "containment" else set()
    assert links == {(2, 1, 1.0), (3, 1, 1.0)} | back


def test_walks_of_many_graphs(spark):
    """Components and recursion of many graphs at once are those of each alone, without a shuffle or a stored round."""
    rng = random.Random(4)
    rows = []
    for k in range(120):
        ids = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 8))] + [None] * (k % 11 == 0)
        edges = [(rng.choice("abcdefghi"), rng.choice([*"abcdefgh", None])) for _ in range(rng.randint(0, 5))]
        packs = [(rng.choice("pqrs"), rng.choice([[], ["p", "q"], ["r", None], ["s", "a"], ["q", "q"]])) for _ in range(rng.randint(0, 4))]
        rows.append((k, ids, edges, packs))
    kind = "k int, ids array<string>, edges array<struct<a: string, b: string>>, packs array<struct<p: string, c: array<string>>>"
    df = spark.createDataFrame([*rows, (999, None, None, None)], kind)
    got = {r[0]: (r[1][0], r[1][1]) for r in df.select("k", graph._walked("ids", "edges.a", "edges.b", "packs.p", "packs.c")).collect()}
    want = {k: (len(graph.reconvergent(dict(packs))), graph.components([i for i in ids if i is not None], edges)) for k, ids, edges, packs in rows}
    assert got == want | {999: (0, 0)} and len(set(want.values())) > 8
    g = F.struct(F.transform("ids", lambda i: F.struct(i.alias("node_id"))).alias("nodes"), F.transform("edges", lambda e: F.struct(e["a"].alias("node_id_from"), e["b"].alias("node_id_to"))).alias("edges"))
    counts = df.select("k", graph.n_components(g).alias("n"))
    assert {r[0]: r[1] for r in counts.collect()} == {k: v[1] for k, v in got.items()}
    none = spark.createDataFrame([(1, ["a", "b"], [], [("p", [])])], kind)
    assert [tuple(r[0]) for r in none.select(graph._walked("ids", "edges.a", "edges.b", "packs.p", "packs.c")).collect()] == [(0, 2)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_checked_once(spark, tmp_path):
    """Messages are worked out once and graphs go over once: no filter repeats messages, no stored table stands between."""
    from quarrymill.plans import queries

    rows = [(k // 3, k % 5, k % 3, k % 3 + 1, float(k % 50), "AN"[k % 2], "OF"[k % 2]) for k in range(30)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = queries.graph_check(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_():") == 1
    rollup = queries.severity_rollup(spark, str(tmp_path))
    plan = rollup._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_():") == 1 and "LogicalRDD" not in plan
    rows = graph.checked(queries.graphs(spark, str(tmp_path)))
    for r in rollup.collect():
        how, average = r["kind"].split()
        one = metrics.defects(rows, "messages", F.lit(False), F.size("graph_clean.nodes"), how, None if average == "None" else average).first()
        assert list(r[1:]) == pytest.approx(list(one), abs=1e-6)
    assert "_():" not in queries.split_share(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "")], "id bigint, text string")
    similarity.save_index(similarity.build_index(similarity.representatives(docs, "id", "text")), f"{tmp_path}/i")
    index = similarity.load_index(spark, f"{tmp_path}/i")
    queries = similarity.representatives(spark.createDataFrame([(9, "a b c new")], "id bigint, text string"), "id", "text")
    assert [tuple(r) for r in similarity.query_index(queries, index, "jaccard", 0.5).collect()] == [(9, 1, 0.6)]


def test_greedy_dedup(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 7)], "a bigint, b bigint")
    assert sorted(r[0] for r in dedup.removed(edges).collect()) == [2, 4]
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept: set[int] = set()
    for i in range(40):
        if not any((min(i, k), max(i, k)) in pairs for k in kept):
            kept.add(i)
    assert {r[0] for r in dedup.removed(spark.createDataFrame(list(pairs), "a bigint, b bigint")).collect()} == set(range(40)) - kept
    docs = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, ""), (4, None), (5, "z")], "id bigint, text string")
    assert sorted(r[0] for r in dedup.deduplicated(docs, "id", "text").collect()) == [1, 3, 4, 5]


def test_prompts(spark):
    ship(spark)
    assert one(spark, prompts.rendered("{code}-{zzz}", {"code": F.lit(1)})) == ["1-zzz"]
    with pytest.raises(KeyError):
        prompts.rendered("{zzz}", {}, strict=True)
    df = spark.createDataFrame([("a b",), ("c",)], "code string")
    config = prompts.EngineConfig(retries=1, extract=prompts.last_tag(("o",)))
    got = prompts.generated(df, prompts.Prompt("s", "{code}"), lambda chat, params: (f"<o>{chat[-1]['content']}</o>", 3), config).collect()
    assert [(r["output"], r["raw_output"], r["total_tokens"]) for r in got] == [("a b", "<o>a b</o>", 3), ("c", "<o>c</o>", 3)]
    failing = prompts.generated(df, prompts.Prompt(None, "{code}"), lambda chat, params: 1 / 0, prompts.EngineConfig(retries=1)).first()
    assert failing["output"] is None and failing["total_tokens"] == 0


def test_kappa(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)]
    r = metrics.kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert r["n"] == 50 and r["kappa"] == pytest.approx(0.4) and r["low"] < 0.4 < r["high"]
    assert metrics.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] is None


def test_macro_without_value_counts_one(spark):
    counts = spark.createDataFrame([("s", "e", None, None, None, None)], "k string, x string, Sufficiency bigint, Completeness bigint, Verbosity bigint, Hallucinations bigint")
    assert metrics.macro(counts, metrics.sample_maxima(counts, "k"), "k", "x").first()["precision"] == 1.0


def test_severity_of_last_message(spark):
    messages = F.lit(None).cast(graph.MESSAGES)
    df = spark.createDataFrame([([("R1", "", "Low", 3), ("R2", "", "Low", 1)],)], f"m {graph.MESSAGES}")
    take = lambda how: list(df.select(*metrics.severities(F.col("m"), F.lit(False), how)).first())
    assert take("last") == [1.0, 0.0, 0.0] and take("sum") == [4.0, 0.0, 0.0] and take("unique") == [1.0, 0.0, 0.0]
    assert messages is not None


def node(kind, name, source=None, **more):
    return {"type": kind, "name": name, "node_id": name, "description": "", "visibility": "public", "return_type": None, "params": None, "source_class_id": source} | more


def edge(a, b, d=None):
    return {"node_id_from": a, "node_id_to": b, "description": d}


def package(p, children):
    return {"package_id": p, "children": children, "description": None}


EXAMPLE = {"nodes": [node("class", "A", description="d"), node("method", "m", "A", params="x", return_type="int")], "edges": [edge("A", "m")], "packages": [package("P", ["A"])]}


def test_plantuml():
    assert render.draw(EXAMPLE) == '@startuml\nset separator none\nhide empty members\npackage P {\nclass A {\nd\n}\nclass m << (M,tomato) >>{\n+m(x) : int\n}\n}\n"A" --> "m"\n@enduml'


def test_folded_members():
    text = render.draw(EXAMPLE, outside_members=False)
    assert "class A {\nd\n--\n+m(x) : int\n}" in text and "-->" not in text and "tomato" not in text


def test_other_dialects():
    chart = render.draw(EXAMPLE, "flowchart")
    assert chart.startswith("flowchart TB\nsubgraph P\n") and 'm["\nm<hr color="black"/>+m(x) int\n"]:::method' in chart and chart.endswith("classDef field fill:lightblue")
    assert "namespace P {" in render.draw(EXAMPLE, "mermaid")
    assert render.draw({"nodes": [node("variable", "v")], "edges": [], "packages": []}, "mermaid") is None
    assert "+Any v" in render.draw({"nodes": [node("variable", "v")], "edges": [], "packages": []})


def test_nested_packages_and_cycles():
    g = {"nodes": [node("class", c, return_type="x") for c in "ab"], "edges": [edge("a", "b", "1"), edge("a", "b", "2")], "packages": [package("C", ["a"]), package("B", ["C", "b", "B"])]}
    text = render.draw(g)
    assert text.count("class a") == 1 and text.index("package B") < text.index("package C") and '"a" --> "b" : "2"' in text and '"1"' not in text


def test_recursion_and_components():
    assert graph.reconvergent({"A": ["B", "C"], "B": ["D"], "C": ["D"], "D": []}) == ["A"]
    assert graph.reconvergent({"A": ["B"], "B": ["x"]}) == []
    assert graph.reconvergent({"A": ["A"]}) == ["A"]
    assert graph.components(["a", "b", "c"], [("a", "b")]) == 2


def rules(spark, g, code=""):
    ship(spark)
    df = spark.createDataFrame([(g, code)], f"graph {graph.GRAPH}, code string")
    return {m["rule"]: m["number"] for m in graph.checked(df, warnings=True).first()["messages"]}


def test_rules(spark):
    g = {"nodes": [node("class", "A b"), node("method", "~X"), node("field", "ok-bad", "A b")], "edges": [edge("A b", "gone"), edge("~X", "~X"), edge("~X", "~X")], "packages": [package("P", []), package("Q", ["~X"]), package("A b", [])]}
    got = rules(spark, g, "A b ~X")
    want = {"R1": 1, "R4": 1, "R5": 1, "R7": 1, "R9": 1, "R10": 1, "R11": 1, "R12": 1, "R14": 1, "R15": 1, "R16": 1, "R18": 1, "R19": 1, "R20": 1, "R21": 1, "R24": 1}
    assert got == want
    assert rules(spark, None) == {}


def test_literal_parse(spark):
    ship(spark)
    df = spark.createDataFrame([(str(EXAMPLE),), ("{'nodes': [",), (None,)], "t string")
    got = df.select(graph.parsed(F.col("t")).alias("g")).select("g", graph.is_valid(F.col("g")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False] and got[0]["g"]["nodes"][1]["source_class_id"] == "A"


def test_migration(spark):
    schema = "STRUCT<nodes: ARRAY<STRUCT<type: STRING, name: STRING, description: STRING, visibility: STRING, return_type: STRING, params: STRING>>, edges: ARRAY<STRUCT<name_from: STRING, name_to: STRING, description: STRING>>, packages: ARRAY<STRUCT<name: STRING, children: ARRAY<STRING>, description: STRING>>>"
    g = {"nodes": [{"type": "class", "name": "A"}, {"type": "method", "name": "m"}, {"type": "method", "name": "k"}], "edges": [{"name_from": "A", "name_to": "m"}], "packages": [{"name": "P", "children": ["A"]}]}
    new = spark.createDataFrame([(g,)], f"g {schema}").select(graph.migrated(F.col("g"))).first()[0]
    assert [n["source_class_id"] for n in new["nodes"]] == [None, "A", None] and new["packages"][0]["package_id"] == "P"


def test_files(spark, tmp_path):
    ship(spark)
    os.makedirs(tmp_path / "o/r/sub")
    (tmp_path / "o/r/a.py").write_text(" x = 1\n")
    (tmp_path / "o/r/sub/b.tar.py").write_bytes(b"\xff\\n")
    (tmp_path / "o/r/.py").write_text("no")
    (tmp_path / "o/r/c.txt").write_text("no")
    ext = files.extension_map(spark.createDataFrame([(0, "C", [".py"]), (1, "Python", [".py"]), (2, "Cobol", [".py"])], "position int, name string, extensions array<string>"), ["C", "Python"])
    got = sorted((os.path.basename(r["path"]), r["code"], r["language"]) for r in files.source_files(spark, f"file:{tmp_path}", ext).collect())
    assert got == [("a.py", "x = 1", "Python"), ("b.tar.py", "ÿ", "Python")]
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_array(spark, f"{tmp_path}/x.json").count() == 2
    files.write_csv_with_index(spark.range(3), f"{tmp_path}/csv", [F.desc("id")])
    assert sorted((r["index"], r["id"]) for r in files.csv(spark, f"{tmp_path}/csv").collect()) == [("0", "2"), ("1", "1"), ("2", "0")]
    assert files.report(spark.range(1).select((F.col("id") + 0.12345).alias("x"))) == "| x |\n|---|\n| 0.123 |"


def _node(i, kind="class", name=None, owner=None):
    return (kind, name or i, i, "", "public", "int", None, owner)


def test_every_rule_fires(spark):
    """A small graph for each rule; what each one counts is worked out by hand."""
    e = lambda a, b: (a, b, None)
    cases = {
        "R4": (([_node("a"), _node("b")], [e("a", "b")], [("P", ["a"], None), ("P", ["b"], None), ("a", ["b"], None)]), 2),
        "R6": (([_node("a")], [], []), 1),
        "R7": (([_node("a")], [], []), 1),
        "R8": (([_node("a"), _node("b")], [], []), 1),
        "R13": (([_node("a"), _node("m", "method", owner="a")], [e("m", "a")], []), 1),
        "R15": (([_node("a", name="~a"), _node("b", name="ok-b")], [e("a", "b")], []), 1),
        "R16": (([_node("~a"), _node("b")], [e("~a", "b")], []), 1),
        "R17": (([_node("a")], [], [("~P", ["a"], None), ("/Q", ["a"], None)]), 1),
        "R21": (([_node("a")], [], [("P", [], None), ("Q", None, None), ("R", [None], None)]), 3),
        "R22w": (([_node("a")], [], [("P", ["a"], None), ("Q", ["a"], None), ("R", ["a"], None)]), 2),
        "R22m": (([_node("a"), _node("m", "method", owner="a"), _node("n", "method", owner="a")], [e("a", "m")], [("P", ["a", "n"], None), ("Q", ["m"], None)]), 1),
        "R23": (([_node("a")], [], [("P", ["Q"], None), ("Q", ["P", "a"], None)]), 1),
    }
    rows = spark.createDataFrame([(r, g, "a b m n") for r, (g, _) in cases.items()], f"rule string, graph {graph.GRAPH}, code string")
    got = {r["rule"]: {m["rule"]: m["number"] for m in r["messages"]} for r in graph.checked(rows, warnings=True).collect()}
    assert {r: got[r].get(r) for r in cases} == {r: n for r, (_, n) in cases.items()}


def test_nulls_and_depth(spark):
    deep = [(f"P{i}", [f"P{i + 1}"] if i < 1999 else ["a"], None) for i in range(2000)]
    graphs = [([_node("a"), None], [("a", "a", None), None], [("P", None, None), None]), (None, None, None), ([_node("a")], [], deep), ([_node("a")], [], list(reversed(deep))), None]
    df = spark.createDataFrame([(i, g, "a") for i, g in enumerate(graphs)], f"id int, graph {graph.GRAPH}, code string")
    rows = graph.checked(df, warnings=True).withColumn("text", render.rendered(F.col("graph_clean"))).orderBy("id").collect()
    assert len(rows) == 5 and [r["text"] is None for r in rows] == [False, False, False, False, True]
    assert "class a {" in rows[0]["text"] and "package P {" in rows[0]["text"] and rows[2]["text"] == rows[3]["text"]
    assert rows[2]["text"].count("package ") == 2000 and rows[2]["text"].count("class a") == 1


def test_drawn_packages_own_each_node_once():
    rng = random.Random(4)
    for _ in range(300):
        names = [f"p{i}" for i in range(rng.randint(1, 6))]
        inside = {p: dict.fromkeys(rng.choice([*names, "a", "b", "c"]) for _ in range(rng.randint(0, 4))) for p in names}
        prints, roots = render.owned(inside, {"a", "b", "c"})
        listed = [c for p in prints for c, _ in prints[p]]
        assert set(prints) == set(names) and len(listed) == len(set(listed)) and not set(roots) & set(listed)
        assert {c for c in listed if c in "abc"} == {c for children in inside.values() for c in children if c in "abc"}
        assert set(roots) | {c for c in listed if c in prints} == set(names)  # each package once, a cycle broken where the walk began


def test_text_to_diagram(spark):
    good = "{'nodes': [{'type': 'class', 'name': 'a', 'node_id': 'a', 'description': '', 'visibility': 'public', 'return_type': null, 'params': null, 'source_class_id': null}], 'edges': [], 'packages': []}"
    texts = [good, good.replace("public", "open"), "no graph", None]
    rows = graph.from_text(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "id int, text string, code string"), "text").orderBy("id").collect()
    assert [r["diagram"] is not None for r in rows] == [True, False, False, False]
    assert [[m["rule"] for m in r["messages"]] for r in rows] == [["R6", "R8"], ["R6", "R8"], [], []]


def test_json_array(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, None if i % 3 == 0 else f'"{i}"') for i in range(40)], "i int, t string")
    for name, part in (("some", df.repartition(5)), ("none", df.limit(0)), ("one", df.limit(1))):
        files.write_json_array(part, f"{tmp_path}/{name}")
        whole = "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        assert sorted(map(str, json.loads(whole))) == sorted(str(r.asDict()) for r in part.collect())
    with pytest.raises(Exception, match="exists"):
        files.write_json_array(df, f"{tmp_path}/some")


def test_clones(spark, tmp_path):
    import subprocess

    source = tmp_path / "source"
    for args in (["init", "-q", str(source)], ["-C", str(source), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", *args], check=True)
    rows = [(str(source), None, "o", "good"), (str(source), "missing", "o", "bad"), ("--upload-pack=x", None, "o", "option"), (str(source), None, "..", "out")]
    df = spark.createDataFrame(rows, "git_url string, rev string, maintainer string, name string").coalesce(1)
    got = {r["name"]: r["status"] for r in files.cloned(df, str(tmp_path / "to"), retries=1, pause=0.0).collect()}
    assert got == {"good": "Done", "bad": "Error", "option": "Error", "out": "Error"} and (tmp_path / "to/o/good/.git").is_dir()


def test_kappa_near_certainty(spark):
    df = spark.createDataFrame([("x", "x")] * 5, "a string, b string")
    assert metrics.kappa(df, "a", "b").first()["kappa"] is None


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, v int")
    assert sorted(r["v"] for r in curate.large_groups(df, ["k"], 2).collect()) == [2, 3]
