"""Service dependency graph: nodes, edges and longest-path depth."""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslake.plans.sizing import broadcast_if_small, settle

# Fixed value: default caller -> dependencies map, in display order.
DEFAULT_TOPOLOGY = {
    "api_gateway": ["auth_service", "orders_service"],
    "orders_service": ["database"],
    "auth_service": [],
    "database": [],
}


class CyclicTopology(ValueError):
    pass


@dataclass
class Topology:
    """``nodes(service, pos, depth, listed)`` and ``edges(caller, dependency, pos)``.

    ``listed`` marks services that are graph entries themselves; others are only named as someone's dependency.
    """
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_map(cls, spark: SparkSession, topology: dict[str, list[str]] | None = None) -> Topology:
        """From a configuration map; its depths are settled level by level while the plan is made."""
        graph = DEFAULT_TOPOLOGY if topology is None else topology
        edges = [(c, d) for c, deps in graph.items() for d in deps]
        names = list(dict.fromkeys([*graph, *[d for _, d in edges]]))
        called = {d for _, d in edges}
        level = set(n for n in graph if n not in called) or set(graph)
        depth = dict.fromkeys(names, 0)
        reached = 0
        while level:
            if reached > len(names):
                raise CyclicTopology("the dependency graph has a cycle")
            depth.update(dict.fromkeys(level, reached))
            level = {d for c, d in edges if c in level}
            reached += 1
        return cls(
            _values(spark, [(n, i, depth[n], n in graph) for i, n in enumerate(names)],
                    "service string, pos int, depth int, listed boolean"),
            _values(spark, [(c, d, i) for i, (c, d) in enumerate(edges)], "caller string, dependency string, pos int"))

    @classmethod
    def from_tables(cls, nodes: DataFrame, edges: DataFrame) -> Topology:
        """From node and edge tables of any size; the nodes of a cycle share the depth of the cycle."""
        return cls(nodes.join(condensed_depth(nodes, edges).drop("in_cycle"), "service").withColumn("listed", F.lit(True)), edges)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table that Catalyst knows the size of."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema) if rows else spark.createDataFrame([], schema)


def _standing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``service, known, called, own`` of all nodes and dependencies: is a node, has another caller (known or not), calls itself."""
    own = F.coalesce(F.col("caller") == F.col("dependency"), F.lit(False))
    ends = edges.where(F.col("dependency").isNotNull()).select(
        F.col("dependency").alias("service"), F.lit(False).alias("known"), (~own).alias("called"), own.alias("own"))
    rows = nodes.select("service", F.lit(True).alias("known"), F.lit(False).alias("called"), F.lit(False).alias("own")).unionByName(ends)
    return settle(rows.groupBy("service").agg(*[F.max(c).alias(c) for c in ("known", "called", "own")]), "standing")


def _lines(edges: DataFrame, callers: DataFrame) -> DataFrame:
    """The distinct edges of ``callers(service, met)``. Where nothing calls the caller (not ``met``) it is left out as null.

    Most edges of a large graph come from such callers. Here all edges are joined once; what later steps read is one row per
    dependency of these callers, and the edges between nodes that are called themselves.
    """
    state = callers.select(F.col("service").alias("caller"), "met")
    return edges.where(F.col("dependency").isNotNull()).join(broadcast_if_small(state), "caller").select(
        F.when(F.col("met"), F.col("caller")).alias("caller"), "dependency").distinct()


def _levels(left: DataFrame, first: DataFrame, lines: DataFrame) -> DataFrame:
    """``service, depth`` of the nodes ``left``, peeled off level by level; ``first`` are called from the level above them all.

    Nodes without open callers are a level, and each edge is looked at until its caller is peeled. A level that peels nothing
    while nodes are left proves a cycle. Levels are written out, which also cuts the lineage of the loop.
    """
    depth, done = 0, []
    open_calls = first.unionByName(lines.select(F.col("dependency").alias("service")))
    while not left.isEmpty():
        ready = settle(left.join(open_calls, "service", "left_anti"), "ready")
        if depth and ready.isEmpty():
            raise CyclicTopology("the dependency graph has a cycle")
        done.append(ready.withColumn("depth", F.lit(depth)))
        left = settle(left.join(ready, "service", "left_anti"), "left")
        lines = settle(lines.join(ready, lines["caller"] == ready["service"], "left_anti"), "lines")
        open_calls = lines.select(F.col("dependency").alias("service"))
        depth += 1
    best = done[0] if done else left.withColumn("depth", F.lit(0))
    for more in done[1:]:
        best = best.unionByName(more)
    return best


def longest_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``service, depth``: length of the longest path from a node without callers; 0 for nodes that no such path reaches.

    Nodes without callers are set apart with their edges, in one join over all edges. Of the rest, the nodes that can be
    reached are found, each in one step, and peeled off level by level; the level is the depth. A level that peels nothing
    proves a cycle, as does a graph in which all nodes have callers. Edges without a dependency count for nothing.
    """
    standing = _standing(nodes, edges).select("service", "known", (F.col("called") | F.col("own")).alias("met"))
    known = standing.where("known").select("service")
    if standing.where("known AND NOT met").isEmpty() and not known.isEmpty():
        raise CyclicTopology("the dependency graph has a cycle")
    lines = settle(_lines(edges, standing), "lines")
    inner = lines.where(F.col("caller").isNotNull())
    reached = level = first = lines.where(F.col("caller").isNull()).select(F.col("dependency").alias("service"))
    while True:
        level = settle(inner.join(level, inner["caller"] == level["service"], "left_semi").select(F.col("dependency").alias("service"))
                       .distinct().join(reached, "service", "left_anti"), "level")
        if level.isEmpty():
            break
        reached = settle(reached.unionByName(level), "reached")
    best = _levels(reached, first, inner.join(reached, inner["caller"] == reached["service"], "left_semi"))
    return known.join(best, "service", "left").select("service", F.coalesce("depth", F.lit(0)).alias("depth"))


def _between(lines: DataFrame, nodes: DataFrame, how: str = "left_semi") -> DataFrame:
    """The edges of which both ends are among the nodes; with ``left_anti``, those of which neither is."""
    for end in ("caller", "dependency"):
        lines = lines.join(nodes.select(F.col("service").alias(end)), end, how)
    return lines


def _inner_lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The standing of the nodes, and the distinct edges between known nodes that have callers; only these can lie on a cycle."""
    standing = _standing(nodes, edges)
    behind = standing.where("known AND called").withColumn("met", F.lit(True))
    inner = _lines(edges.where(F.col("caller") != F.col("dependency")), behind)
    return standing, settle(inner.join(behind, inner["dependency"] == behind["service"], "left_semi"), "inner")


def _rings(lines: DataFrame) -> DataFrame:
    """``service, component, size`` of all nodes in strong components of two nodes or more, named by their smallest node.

    Nodes that nothing leads to, or that lead nowhere, are trimmed, again and again. What is left is coloured: each node
    takes the smallest node that reaches it; a step hands on the colours that have changed. A node that has its own colour
    then is the smallest of its component, which is what reaches it backwards within the colour. These components are taken
    out and the rest goes round again; each round settles at least one component per colour. Steps are joins and minima on
    written tables, so no component or reach has to fit a task.
    """
    out = lines.select(F.col("caller").alias("service"), F.col("dependency").alias("component")).limit(0)
    while True:
        while True:
            live = settle(lines.select(F.col("caller").alias("service")).distinct().join(
                lines.select(F.col("dependency").alias("service")), "service", "left_semi"), "live")
            kept = settle(_between(lines, live), "lines")
            if kept.count() == lines.count():
                break
            lines = kept
        if lines.isEmpty():
            break
        colours = moved = live.withColumn("colour", F.col("service"))
        while not moved.isEmpty():
            coming = lines.join(moved.select(F.col("service").alias("caller"), "colour"), "caller").groupBy(F.col("dependency").alias("service")).agg(
                F.min("colour").alias("_new"))
            stepped = settle(colours.join(coming, "service", "left").select(
                "service", F.least("colour", "_new").alias("colour"), (F.col("_new") < F.col("colour")).alias("_moved")), "colours")
            colours, moved = stepped.select("service", "colour"), stepped.where("_moved")
        ends = [colours.select(F.col("service").alias(c), F.col("colour").alias(f"_{c}")) for c in ("caller", "dependency")]
        inner = settle(lines.join(ends[0], "caller").join(ends[1], "dependency").where("_caller = _dependency").select("caller", "dependency"), "inner")
        reached = front = settle(colours.where(F.col("service") == F.col("colour")), "roots")
        while True:
            front = settle(inner.join(front.withColumnRenamed("service", "dependency"), "dependency").select(
                F.col("caller").alias("service"), "colour").distinct().join(reached, "service", "left_anti"), "front")
            if front.isEmpty():
                break
            reached = settle(reached.unionByName(front), "reached")
        out = out.unionByName(reached.withColumnRenamed("colour", "component"))
        lines = settle(_between(lines, reached, "left_anti"), "lines")
    sizes = out.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return settle(out.join(sizes, "component").select("service", "component", "size"), "rings")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``service, component``: the smallest node that each node can reach and be reached from, itself included.

    Edges to unknown nodes count for nothing; no nodes give no rows.
    """
    standing, inner = _inner_lines(nodes, edges)
    return standing.where("known").select("service").join(_rings(inner), "service", "left").select(
        "service", F.coalesce("component", "service").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``service, component, size`` of every node on a cycle; a node that calls itself is a cycle of size 1."""
    standing, inner = _inner_lines(nodes, edges)
    rings = _rings(inner)
    alone = standing.where("known AND own").join(rings, "service", "left_anti")
    return rings.unionByName(alone.select("service", F.col("service").alias("component"), F.lit(1).cast("bigint").alias("size")))


def condensed_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``service, depth, in_cycle``: as ``longest_depth``, with the nodes of a cycle taken as one.

    Nodes without callers are set apart first, as there, so components are sought and condensed among the others alone.
    """
    edges = edges.where(F.col("caller") != F.col("dependency"))
    known = _standing(nodes, edges).where("known").select("service", F.col("called").alias("met"))
    behind = known.where("met").select("service")
    lines = _lines(edges, known)
    lines = settle(lines.join(behind, lines["dependency"] == behind["service"], "left_semi"), "lines")
    inner = lines.where(F.col("caller").isNotNull())
    rings = _rings(inner)

    def whole(rows: DataFrame, column: str) -> DataFrame:
        """The column's nodes replaced by their components."""
        parts = rings.select(F.col("service").alias(column), F.col("component").alias("_whole"))
        return rows.join(parts, column, "left").withColumn(column, F.coalesce("_whole", column)).drop("_whole")

    first = settle(whole(lines.where(F.col("caller").isNull()).select(F.col("dependency").alias("service")), "service").distinct(), "first")
    inner = settle(whole(whole(inner, "caller"), "dependency").where("caller <> dependency").distinct(), "condensed")
    members = settle(behind.join(rings, "service", "left").select(
        "service", F.coalesce("component", "service").alias("component"), F.col("component").isNotNull().alias("in_cycle")), "members")
    depths = _levels(members.select(F.col("component").alias("service")).distinct(), first, inner).withColumnRenamed("service", "component")
    best = members.join(depths, "component").select("service", "depth", "in_cycle")
    return known.select("service").join(best, "service", "left").select(
        "service", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
