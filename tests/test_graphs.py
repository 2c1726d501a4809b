"""Closures and routes over chains longer than any fixed depth."""

from quire.operators import graphs


def test_long_chains_keep_their_ends(spark):
    edges = [(f"n{k:02}", f"n{k + 1:02}") for k in range(14)]
    routes = {(r.src, r.dst): r.hops for r in graphs.shortest_routes(spark, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert routes["n00", "n14"] == 14 and len(routes) == 15 * 14 // 2
    edges = [(f"n{k:02}", f"n{k + 1:02}") for k in range(55)]
    depth = {(r.child, r.ancestor): r.depth for r in graphs.closure(spark, spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert depth["n00", "n55"] == 55 and len(depth) == 56 * 55 // 2
