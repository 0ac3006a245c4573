"""Edges and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def closure(edges: DataFrame, most_depth: int = 1000) -> DataFrame:
    """(node, ancestor, depth) of (child, parent), self at depth 0; a cycle ends where it would repeat a node.

    A recursive query; the vocabulary's trees are shallow, and its depth bounds the steps. A path of more than most_depth
    steps is an error (RECURSION_LEVEL_LIMIT_EXCEEDED), never left out.
    """
    spark: SparkSession = edges.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE up(node, ancestor, depth, path) MAX RECURSION LEVEL {depth} AS (
          SELECT n, n, 0, array(n) FROM (SELECT child AS n FROM {edges} UNION SELECT parent FROM {edges}) WHERE n IS NOT NULL
          UNION ALL
          SELECT u.node, e.parent, u.depth + 1, array_append(u.path, e.parent) FROM up u JOIN {edges} e ON u.ancestor = e.child
          WHERE e.parent IS NOT NULL AND NOT array_contains(u.path, e.parent)
        ) SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor
        """,
        edges=edges, depth=int(most_depth) + 1,
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of (src, dst)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def missing_inverse(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Edges (src, relation, dst) whose inverse edge is not there."""
    pairs = F.create_map(*[F.lit(x) for p in inverse.items() for x in p])
    wanted = edges.withColumn("back", F.try_element_at(pairs, F.col("relation"))).filter("back IS NOT NULL")
    have = edges.select(F.col("dst").alias("src"), F.col("relation").alias("back"), F.col("src").alias("dst"))
    return wanted.join(have, ["src", "back", "dst"], "left_anti").select("src", "relation", "dst")


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bindings of one scope that may be used together (scope, phase, phase_system of a and b)."""
    x, y = a.alias("x"), b.alias("y")
    system = F.col("x.phase_system").isNotNull() & F.col("y.phase_system").isNotNull()
    phase = F.col("x.phase").isNull() | F.col("y.phase").isNull() | (F.col("x.phase") == F.col("y.phase"))
    return x.join(y, (F.col("x.scope") == F.col("y.scope")) & F.when(system, F.col("x.phase_system") == F.col("y.phase_system")).otherwise(phase))


def neighbourhood(edges: DataFrame, focus: str) -> DataFrame:
    """(node): focus and the nodes one edge (src, dst) away, either way."""
    near = edges.filter((F.col("src") == focus) | (F.col("dst") == focus)).select(F.explode(F.array("src", "dst")).alias("node"))
    return near.union(edges.sparkSession.createDataFrame([(focus,)], "node string")).distinct()


def visible_edges(edges: DataFrame, nodes: DataFrame, relations: list[str], scope: str | None = None) -> DataFrame:
    """Edges (src, relation, dst, scope) of the chosen relations with both ends among nodes (node); of a scope, if one is
    chosen, together with the edges that state none."""
    found = edges.filter(F.col("relation").isin(relations))
    found = found if scope is None else found.filter(F.col("scope").isNull() | (F.col("scope") == scope))
    return found.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def search(concepts: DataFrame, query: str, texts: list[str], order: str, most: int = 8) -> DataFrame:
    """The first concepts, in their order, of which some text holds the query as it is, but for case; none for a blank query."""
    wanted = query.strip().lower()
    held = F.lower(F.concat_ws(" ", *texts)).contains(wanted) if wanted else F.lit(False)
    return concepts.filter(held).orderBy(order).limit(most)
