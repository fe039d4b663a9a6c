"""Graphs of nodes, edges and packages: parsing, cleaning and checking.

A graph is one struct column. All rules but two are expressions over its arrays; the recursion of packages and the
number of components need a walk and share one Arrow-batched UDF.
"""

from __future__ import annotations

import json
from ast import literal_eval

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import null_to_none, strip

NODE_FIELDS = ("type", "name", "node_id", "description", "visibility", "return_type", "params", "source_class_id")
NODES = f"ARRAY<STRUCT<{', '.join(f'{f}: STRING' for f in NODE_FIELDS)}>>"
EDGES = "ARRAY<STRUCT<node_id_from: STRING, node_id_to: STRING, description: STRING>>"
PACKAGES = "ARRAY<STRUCT<package_id: STRING, children: ARRAY<STRING>, description: STRING>>"
GRAPH = f"STRUCT<nodes: {NODES}, edges: {EDGES}, packages: {PACKAGES}>"
MESSAGES = "ARRAY<STRUCT<rule: STRING, description: STRING, severity: STRING, number: INT>>"

# Fixed values.
VISIBILITIES = ("private", "protected", "package private", "package_private", "internal", "public")
NODE_TYPES = ("class", "variable", "function", "entity", "method", "field")
VERSIONS = ("minimal", "medium", "full")
MEMBERS = ("method", "field")


@F.pandas_udf(T.StringType())
def literal_to_json(texts: pd.Series) -> pd.Series:
    """A Python literal as JSON; null where it is none."""

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(literal_eval(text))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(convert)


def parsed(text: Column, literal: bool = True) -> Column:
    """A graph from text: a Python literal (in which the word null is None), or JSON; null where it can't be read."""
    source = literal_to_json(null_to_none(strip(text))) if literal else strip(text)
    read = lambda x: F.when(x["nodes"].isNotNull() | x["edges"].isNotNull() | x["packages"].isNotNull(), x)
    return F.get(F.transform(F.array(F.from_json(source, GRAPH)), read), F.lit(0))


def is_valid(graph: Column) -> Column:
    """Whether required fields are there and types and visibilities are known."""
    node = lambda n: (
        n["type"].isin(*NODE_TYPES) & n["visibility"].isin(*VISIBILITIES) & n["name"].isNotNull() & n["node_id"].isNotNull()
    )
    ok = (
        F.forall(graph["nodes"], lambda n: F.coalesce(node(n), F.lit(False)))
        & F.forall(graph["edges"], lambda e: e["node_id_from"].isNotNull() & e["node_id_to"].isNotNull())
        & F.forall(graph["packages"], lambda p: p["package_id"].isNotNull() & p["children"].isNotNull())
    )
    return F.coalesce(ok, F.lit(False))


def whole(graph: Column) -> Column:
    """A graph in which null arrays are empty and null elements are not there; a null graph stays null."""
    some = lambda items: F.filter(F.coalesce(items, F.array()), lambda x: x.isNotNull())
    packages = F.transform(some(graph["packages"]), lambda p: p.withField("children", some(p["children"])))
    return F.when(graph.isNotNull(), F.struct(some(graph["nodes"]).alias("nodes"), some(graph["edges"]).alias("edges"), packages.alias("packages")))


def _bare(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def _parts(df: DataFrame, graph: str) -> DataFrame:
    """Raw ids next to the graph: __ids of nodes, __pids of packages that are no node's."""
    ids = F.transform(F.col(graph)["nodes"], lambda n: n["node_id"])
    df = df.withColumn("__ids", F.array_distinct(ids))
    return df.withColumn("__pids", F.array_distinct(F.filter(F.transform(F.col(graph)["packages"], lambda p: p["package_id"]), lambda p: ~F.array_contains("__ids", p))))


def cleaned(df: DataFrame, graph: str = "graph", lenient: bool = False) -> DataFrame:
    """df with <graph>_clean: ids without spaces, without dangling edges, unknown children and packages that collide with nodes.

    A package collides if its id is a node's, or its id without spaces is one; lenient looks at the latter alone.
    Null arrays of the graph become empty and null elements go, in the graph too.
    """
    df = df.withColumn(graph, whole(F.col(graph)))
    rows = _parts(df, graph)
    g = F.col(graph)
    child = lambda c: F.array_contains("__ids", c) | (F.array_contains(F.transform(g["packages"], lambda p: p["package_id"]), c) if lenient else F.array_contains("__pids", c))
    nodes = F.transform(g["nodes"], lambda n: n.withField("node_id", _bare(n["node_id"])))
    edges = F.transform(
        F.filter(g["edges"], lambda e: F.array_contains("__ids", e["node_id_from"]) & F.array_contains("__ids", e["node_id_to"])),
        lambda e: e.withField("node_id_from", _bare(e["node_id_from"])).withField("node_id_to", _bare(e["node_id_to"])),
    )
    stays = lambda p: ~F.array_contains("__ids", _bare(p["package_id"])) & (F.lit(True) if lenient else F.array_contains("__pids", p["package_id"]))
    packages = F.transform(
        F.filter(g["packages"], stays),
        lambda p: p.withField("package_id", _bare(p["package_id"])).withField("children", F.transform(F.filter(p["children"], child), _bare)),
    )
    return rows.withColumn(f"{graph}_clean", F.struct(nodes.alias("nodes"), edges.alias("edges"), packages.alias("packages"))).drop("__ids", "__pids")


def migrated(graph: Column) -> Column:
    """A graph whose nodes are known by name (edges name_from, name_to; packages name, children) in today's form.

    A method or field belongs to a class only if exactly one edge comes to it from a class.
    """
    parents = lambda n: F.filter(
        F.transform(F.filter(graph["edges"], lambda e: e["name_to"] == n["name"]), lambda e: e["name_from"]),
        lambda p: F.get(F.transform(F.filter(graph["nodes"], lambda m: m["name"] == p), lambda m: m["type"]), F.size(F.filter(graph["nodes"], lambda m: m["name"] == p)) - 1) == "class",
    )
    nodes = F.transform(
        graph["nodes"],
        lambda n: F.struct(
            *[n[f].alias(f) for f in ("type", "name")],
            n["name"].alias("node_id"),
            *[n[f].alias(f) for f in ("description", "visibility", "return_type", "params")],
            F.when(n["type"].isin(*MEMBERS) & (F.size(parents(n)) == 1), F.get(parents(n), F.lit(0))).alias("source_class_id"),
        ),
    )
    edges = F.transform(graph["edges"], lambda e: F.struct(e["name_from"].alias("node_id_from"), e["name_to"].alias("node_id_to"), e["description"].alias("description")))
    packages = F.transform(graph["packages"], lambda p: F.struct(p["name"].alias("package_id"), p["children"].alias("children"), p["description"].alias("description")))
    return F.struct(nodes.alias("nodes"), edges.alias("edges"), packages.alias("packages"))


def components(nodes: list[str], edges: list[tuple[str, str]]) -> int:
    """Weakly connected components, isolated nodes among them."""
    parent = {n: n for n in nodes}

    def top(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        parent[top(a)] = top(b)
    return sum(top(n) == n for n in parent)


def reconvergent(children: dict[str, list[str]]) -> list[str]:
    """Packages from which a walk down comes to some package twice, by a cycle or by two ways.

    Walks start, in order, at packages that no walk has come to; each ends where it comes to a package again.
    """
    seen, found = set(), []
    for root in children:
        if root in seen:
            continue
        reached, ways = {root}, [iter(children[root])]
        while ways:
            step = next((c for c in ways[-1] if c in children), None)
            if step is None:
                ways.pop()
            elif step in reached:
                found.append(root)
                break
            else:
                reached.add(step)
                ways.append(iter(children[step]))
        seen |= reached
    return found


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of each value of a column of lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _coded(*columns: pa.Array) -> tuple[list[np.ndarray], int]:
    """Values of columns as numbers, the same for all of them, and the number that null has, the largest."""
    some = [c for c in columns if len(c)]  # an empty column may come without offsets
    words = (pa.concat_arrays(some) if some else pa.array([], pa.string())).dictionary_encode()
    none = len(words.dictionary)
    codes = words.indices.fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), none


def _component_counts(ids: pa.Array, froms: pa.Array, tos: pa.Array) -> np.ndarray:
    """components() of each row, of all rows at once: labels go to the smaller end of each edge, then to their label's label."""
    (node, a, b), none = _coded(ids.flatten(), froms.flatten(), tos.flatten())
    own, at, to = _rows_of(ids)[node < none] * (none + 1), _rows_of(froms) * (none + 1), _rows_of(tos) * (none + 1)
    every, where = np.unique(np.concatenate([own + node[node < none], at + a, to + b]), return_inverse=True)
    a, b = where[len(own) : len(own) + len(a)], where[len(own) + len(a) :]
    label = np.arange(len(every))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != (label := label[label])).any():
            pass
    return np.bincount(every[label == np.arange(len(label))] // (none + 1), minlength=len(ids))


def _reconvergent_counts(pids: pa.Array, children: pa.Array) -> np.ndarray:
    """How many packages of each row reconvergent() finds; it walks only where two packages or more lie in packages, or one in itself."""
    lists = children.flatten()
    row = _rows_of(children)
    (own, child), none = _coded(pids.flatten(), lists.flatten())
    holder = _rows_of(lists)
    inner = np.isin(row[holder] * (none + 1) + child, (_rows_of(pids) * (none + 1) + own)[own < none])
    few = np.bincount(row[holder][inner], minlength=len(pids)) < 2
    few[row[holder][inner & (own[holder] == child)]] = False
    found = np.zeros(len(pids), np.int64)
    for k in np.flatnonzero(~few):
        found[k] = len(reconvergent({p: c or [] for p, c in zip(pids[int(k)].as_py(), children[int(k)].as_py(), strict=True) if p is not None}))
    return found


@F.arrow_udf(T.StructType([T.StructField("recursive", T.IntegerType()), T.StructField("components", T.IntegerType())]))
def _walked(ids: pa.Array, froms: pa.Array, tos: pa.Array, pids: pa.Array, children: pa.Array) -> pa.Array:
    counts = _reconvergent_counts(pids, children), _component_counts(ids, froms, tos)
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], names=["recursive", "components"])


@F.arrow_udf(T.LongType())
def _counted(ids: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
    return pa.array(_component_counts(ids, froms, tos), pa.int64())


def n_components(graph: Column) -> Column:
    """How many weakly connected components a graph has, isolated nodes among them; null for a null graph."""
    return F.when(graph.isNotNull(), _counted(graph["nodes"]["node_id"], graph["edges"]["node_id_from"], graph["edges"]["node_id_to"]))


def checked(df: DataFrame, graph: str = "graph", code: str = "code", warnings: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """df with <graph>_clean and messages: what is wrong with each graph, in a fixed order of rules. A null graph has none. only: names of rules, of which alone messages are wanted."""
    rows = _parts(cleaned(df, graph), graph)
    g = F.col(f"{graph}_clean")
    walk = _walked.asNondeterministic()(g["nodes"]["node_id"], g["edges"]["node_id_from"], g["edges"]["node_id_to"], g["packages"]["package_id"], g["packages"]["children"])  # so that filters on messages stay above it
    all_of = F.flatten(F.transform(g["packages"], lambda p: p["children"]))
    pairs = F.transform(g["edges"], _pair)
    rows = rows.withColumns({"__walk": walk, "__pairs": pairs, "__all": all_of})
    of = {"raw": F.col(graph), "clean": g, "ids": F.col("__ids"), "pids": F.col("__pids"), "pairs": F.col("__pairs"), "all": F.col("__all"), "walk": F.col("__walk"), "code": F.col(code)}
    # Bound to a variable, so that no rule works the parts out again for each element that it looks at.
    found = F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in of.items()])), lambda x: _messages(x, warnings, only)), F.lit(0))
    messages = F.when(F.col(graph).isNull(), F.array().cast(MESSAGES)).otherwise(found)
    return rows.withColumn("messages", messages).drop("__ids", "__pids", "__pairs", "__all", "__walk")


def _pair(e: Column) -> Column:
    return F.concat(e["node_id_from"], F.lit("\x00"), e["node_id_to"])


def _messages(x: Column, warnings: bool, only: tuple[str, ...] | None) -> Column:
    """Messages on x: raw and clean graph, ids, pids, pairs of edges, children of all packages, walk, code."""
    raw, nodes, edges, packages = x["raw"], x["clean"]["nodes"], x["clean"]["edges"], x["clean"]["packages"]
    members = F.filter(nodes, lambda n: n["type"].isin(*MEMBERS))
    linked = lambda a, b: F.exists(edges, lambda e: (e["node_id_from"] == a) & (e["node_id_to"] == b))
    count = lambda items, test: F.size(F.filter(items, test))
    again = F.filter(edges, lambda e, i: F.array_position(x["pairs"], _pair(e)) <= i)
    holders = lambda i: F.flatten(F.transform(packages, lambda p: F.transform(F.filter(p["children"], lambda c: c == i), lambda c: p["package_id"])))
    inside = lambda pid, i: F.array_contains(F.element_at(F.filter(packages, lambda p: p["package_id"] == pid), -1)["children"], i)

    def strays(n: Column) -> Column:
        def apart(h: Column) -> Column:
            of_class, own = h["of_class"], h["own"]
            elsewhere = (F.size(own) == 1) & (F.get(of_class, F.lit(0)) != F.get(own, F.lit(0))) & ~inside(F.get(of_class, F.lit(0)), F.get(own, F.lit(0)))
            return (F.size(of_class) == 1) & ((F.size(own) == 0) | elsewhere)

        return F.exists(F.array(F.struct(holders(n["source_class_id"]).alias("of_class"), holders(n["node_id"]).alias("own"))), apart)  # so that each is looked for once

    one = lambda test: F.when(test, 1).otherwise(0)
    # (rule, what it says, severity, number, only with warnings)
    rules = [
        ("R1", "node ids with spaces", "Low", count(x["ids"], lambda i: i.contains(" ")), False),
        ("R2", "package ids with spaces", "Low", count(x["pids"], lambda i: i.contains(" ")), False),
        ("R3", "node ids that are not unique", "Medium", F.size(raw["nodes"]) - F.size(x["ids"]), False),
        ("R4", "package ids that are not unique or are nodes", "Medium", F.size(raw["packages"]) - F.size(x["pids"]), False),
        ("R5", "edges without both nodes", "Medium", F.size(raw["edges"]) - F.size(edges), False),
        ("R6", "a single node", "Low", one(F.size(nodes) == 1), False),
        ("R7", "three nodes or fewer", "Low", one(F.size(nodes) <= 3), True),
        ("R8", "no edges", "Low", one(F.size(edges) == 0), False),
        ("R9", "nodes with an edge to themselves", "Low", F.size(F.array_distinct(F.transform(F.filter(edges, lambda e: e["node_id_from"] == e["node_id_to"]), lambda e: e["node_id_from"]))), False),
        ("R10", "edges that are not unique", "Low", F.size(edges) - F.size(F.array_distinct(F.transform(edges, lambda e: F.concat(e["node_id_from"], F.lit("->"), e["node_id_to"])))), False),
        ("R11", "nodes with several edges to one node", "Low", F.size(F.array_distinct(F.transform(again, lambda e: e["node_id_from"]))), False),
        ("R12", "members without a class", "Medium", count(members, lambda n: n["source_class_id"].isNull()), False),
        ("R13", "members with an edge to their class", "Low", count(members, lambda n: n["source_class_id"].isNotNull() & linked(n["node_id"], n["source_class_id"])), False),
        ("R14", "members without an edge from their class", "Low", count(members, lambda n: n["source_class_id"].isNotNull() & ~linked(n["source_class_id"], n["node_id"])), False),
        ("R15", "node names that start with another sign", "Low", count(nodes, lambda n: n["name"].rlike("^[^a-zA-Z0-9_]")), False),
        ("R16", "node ids that start with another sign", "Low", count(nodes, lambda n: n["node_id"].rlike("^[^a-zA-Z0-9_]")), False),
        ("R17", "package ids that start with another sign", "Low", count(packages, lambda p: p["package_id"].rlike(r"^[^a-zA-Z0-9_():\\/ ]")), False),
        ("R18", "ids that are not the names", "Low", count(nodes, lambda n: n["node_id"] != n["name"]), True),
        ("R19", "names that are not in the code", "Low", count(nodes, lambda n: (n["type"] != "entity") & ~F.contains(x["code"], n["name"])), False),
        ("R20", "packages with one child", "Low", count(packages, lambda p: F.size(p["children"]) == 1), False),
        ("R21", "packages without children", "Medium", count(packages, lambda p: F.size(p["children"]) == 0), False),
        ("R22", "children of several packages", "Low", count(F.array_distinct(x["all"]), lambda c: count(x["all"], lambda o: o == c) > 1), False),
        ("R22w", "more packages than nodes", "Low", F.greatest(F.size(packages) - F.size(nodes), F.lit(0)), True),
        ("R22m", "members outside the package of their class", "Low", count(members, strays), False),
        ("R23", "packages with recursion", "Medium", x["walk"]["recursive"], False),
        ("R24", "several components", "Medium", one(x["walk"]["components"] > 1), False),
    ]
    said = [(rule, text, severity, number) for rule, text, severity, number, warning in rules if (warnings or not warning if only is None else rule in only)]
    texts = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(("rule", "description", "severity"), x, strict=False)]) for x in said])
    # Each number is worked out once and then looked at.
    each = F.transform(F.array(*[x[-1].cast("int") for x in said]), lambda n, i: F.struct(*[F.get(texts, i)[f].alias(f) for f in ("rule", "description", "severity")], n.alias("number")))
    return F.filter(each, lambda m: m["number"] > 0)


def from_text(df: DataFrame, text: str, code: str = "code", dialect: str = "plantuml", outside_members: bool = True, hide_empty_members: bool = True, literal: bool = True) -> DataFrame:
    """df with graph, graph_clean, messages and diagram, from a column of texts of graphs.

    A null text, or one that can't be read, has no graph, no messages and no diagram. A graph that is not valid, or
    that the dialect can't draw, has messages and no diagram.
    """
    from quarrymill.operators.render import rendered

    rows = checked(df.withColumn("graph", parsed(F.col(text), literal)), "graph", code)
    drawn = rendered(F.col("graph_clean"), dialect, outside_members, hide_empty_members)
    return rows.withColumn("diagram", F.when(F.col("graph").isNotNull() & is_valid(F.col("graph_clean")), drawn))


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, root for graphs in long form: the smallest node of each component. nodes: graph_id, node_id; edges: graph_id, a, b.

    Labels spread along edges and then jump to their label's label; rounds grow with the logarithm of paths.
    """
    from quarrymill.plans.storage import cut

    both = edges.select("graph_id", "a", "b").union(edges.select("graph_id", F.col("b"), F.col("a"))).distinct()
    both = cut(both)
    labels = cut(nodes.select("graph_id", "node_id").union(both.select("graph_id", F.col("a"))).distinct().withColumn("root", F.col("node_id")))
    while True:
        near = both.join(labels.select("graph_id", F.col("node_id").alias("b"), F.col("root").alias("r")), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node_id")).agg(F.min("r").alias("r"))
        spread = labels.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        hop = spread.select("graph_id", F.col("node_id").alias("root"), F.col("root").alias("far"))
        moved = cut(spread.join(hop, ["graph_id", "root"], "left").select("graph_id", "node_id", F.least("root", "far").alias("root"), "old"))
        labels = moved.select("graph_id", "node_id", "root")
        if moved.where("root <> old").isEmpty():
            return labels


