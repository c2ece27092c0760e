"""A segment within the tolerance gives no edge, but its node."""

from landreach.plans import steps


def test_isolated_nodes(spark, tmp_path):
    roads = [(1, "osm_trunk", 0, [(0.0, 0.0), (100.0, 0.0)]), (2, "osm_trunk", 0, [(500.0, 500.0), (501.0, 500.0)]), (3, "osm_trunk", 0, [(100.0, 0.0), (101.0, 0.0)])]
    spark.createDataFrame(roads, "road long, source string, part int, shape array<struct<x: double, y: double>>").write.parquet(str(tmp_path / "roads"))
    e = steps.build_graph(spark, str(tmp_path / "roads"), str(tmp_path / "graph"))
    nodes = spark.read.parquet(str(tmp_path / "graph" / "nodes")).collect()
    main = spark.read.parquet(str(tmp_path / "graph" / "main")).collect()
    assert e.count() == 1 and sorted((n.x, n.y) for n in nodes) == [(0.0, 0.0), (100.0, 0.0), (500.0, 500.0)]
    assert {n.node_id for n in main} == {n.node_id for n in nodes if n.y == 0.0}
