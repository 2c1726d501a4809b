"""Closures and routes over small rule graphs (schemas, mappings, inclusions) as recursive SQL.

The graphs are rule tables of bounded size; data never enters these queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def _nodes(edges: DataFrame) -> int:
    """The number of nodes, which no shortest chain exceeds."""
    a, b = edges.columns[:2]
    return edges.select(a).union(edges.select(b)).distinct().count()


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth): least depth of each ancestor over edges (child, parent)."""
    v, most = _view(edges, "quire_edges"), _nodes(edges.select("child", "parent"))
    return spark.sql(f"""
      WITH RECURSIVE up(child, ancestor, depth) MAX RECURSION LEVEL {most + 2} AS (
        SELECT child, parent, 1 FROM {v}
        UNION ALL
        SELECT up.child, e.parent, depth + 1 FROM up JOIN {v} e ON up.ancestor = e.child WHERE depth < {most})
      SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor""")


def shortest_routes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(src, dst, hops, n_routes, route): a shortest route; several of that length make it ambiguous."""
    v, most = _view(edges, "quire_edges"), _nodes(edges.select("src", "dst"))
    return spark.sql(f"""
      WITH RECURSIVE go(src, dst, hops, path) MAX RECURSION LEVEL {most + 2} AS (
        SELECT src, dst, 1, array(src, dst) FROM {v}
        UNION ALL
        SELECT go.src, e.dst, hops + 1, concat(path, array(e.dst)) FROM go JOIN {v} e ON go.dst = e.src
        WHERE NOT array_contains(path, e.dst) AND hops < {most}),
      least AS (SELECT src, dst, min(hops) AS hops FROM go GROUP BY src, dst)
      SELECT go.src, go.dst, go.hops, count(*) AS n_routes, min(array_join(path, '>')) AS route
      FROM go JOIN least USING (src, dst, hops) GROUP BY go.src, go.dst, go.hops""")


def inclusion_cycles(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(file, chain): files that include themselves, with the least chain of names."""
    v = _view(edges, "quire_edges")
    return spark.sql(f"""
      WITH RECURSIVE into(file, at, path, cyclic) AS (
        SELECT src, dst, array(src, dst), src = dst FROM {v}
        UNION ALL
        SELECT file, e.dst, concat(path, array(e.dst)), e.dst = file FROM into JOIN {v} e ON into.at = e.src
        WHERE NOT cyclic AND (e.dst = file OR NOT array_contains(path, e.dst)))
      SELECT file, min(array_join(path, '>')) AS chain FROM into WHERE cyclic GROUP BY file""")
