"""Popularity over edges that are spread over tasks by their number."""

from vireo.operators import relations


def test_a_task_finds_a_bounded_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(relations, "EDGES", 1_000)
    edges = spark.range(0, 20_000, 1, 1).selectExpr("cast(id % 5000 as string) as package", "cast(id % 7 as string) as dependency")  # two in three of a package's
    edges = edges.unionByName(edges)
    found = relations.distinct_edges(edges)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == edges.distinct().count() and max(sizes) <= 2 * 1_000
    known = spark.createDataFrame([("0",), ("3",), ("3",), ("x",)], "package string")
    users = {r["package"]: r["users"] for r in relations.popularity(edges, known).collect()}
    want = {k: len({i % 5000 for i in range(20_000) if i % 7 == int(k)}) for k in ("0", "3")}
    assert users == want


def test_users_that_are_null_do_not_count(spark):
    """As in SQL."""
    edges = spark.createDataFrame([("a", "p"), (None, "p"), ("a", "p"), (None, "q"), ("a", None)], "package string, dependency string")
    known = spark.createDataFrame([("p",), ("q",), ("r",)], "package string")
    assert {tuple(r) for r in relations.popularity(edges, known).collect()} == {("p", 1), ("q", 0)}
