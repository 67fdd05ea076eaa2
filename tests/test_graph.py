"""Patterns, hops, results and changes on small graphs."""

import pytest
from pyspark.sql import functions as F

from weftgraph import ConstraintError, Graph, PlanError, StorageError, load, p, save, v
from weftgraph.queries import QUERIES
from weftgraph.sources import store
from weftgraph.streaming.rows import arriving


@pytest.fixture(scope="module")
def people(spark):
    """Alice knows Bob (2020) and, twice, Carol; Bob knows himself; Dan knows nobody."""
    g = Graph(spark).with_nodes("Person", spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 20), (3, "Carol", None), (4, "Dan", 40)], "k int, name string, age int"), "k")
    edges = spark.createDataFrame([(1, 1, 2, 2020), (2, 1, 3, 2021), (3, 1, 3, 2022), (4, 2, 2, 2023)], "id long, s long, d long, since long")
    return g.with_edges("KNOWS", edges.select("id", g.node_id("Person", "s").alias("src"), g.node_id("Person", "d").alias("dst"), "since"), "Person", "Person")


def got(result):
    return sorted(map(tuple, result.collect()), key=str)


def test_scan_and_inline_properties(people):
    assert got(people.match("n", "Person", {"name": "Bob"}).returns(p("n.age"))) == [(20,)]
    assert got(people.match("n", "Nobody").returns(p("n.name"))) == []
    assert len(people.match("n").returns(v("n")).collect()) == 4


def test_missing_values_are_smallest(people):
    assert got(people.match("n", "Person").filter(p("n.age") < 30).returns(p("n.name"))) == [("Bob",), ("Carol",)]
    assert got(people.match("n", "Person").filter(p("n.age") != 30).returns(p("n.name"))) == [("Bob",), ("Carol",), ("Dan",)]
    names = [r[0] for r in people.match("n", "Person").returns(p("n.name"), order_by=[p("n.age")]).collect()]
    assert names == ["Carol", "Bob", "Alice", "Dan"]
    names = [r[0] for r in people.match("n", "Person").returns(p("n.name"), order_by=[(p("n.age"), "desc")], skip=1, limit=2).collect()]
    assert names == ["Alice", "Bob"]


@pytest.mark.parametrize(
    "direction,pairs",
    [
        ("out", [("Alice", "Bob"), ("Alice", "Carol"), ("Alice", "Carol"), ("Bob", "Bob")]),
        ("in", [("Bob", "Alice"), ("Bob", "Bob"), ("Carol", "Alice"), ("Carol", "Alice")]),
        ("both", [("Alice", "Bob"), ("Alice", "Carol"), ("Alice", "Carol"), ("Bob", "Alice"), ("Bob", "Bob"), ("Carol", "Alice"), ("Carol", "Alice")]),
    ],
)
def test_directions_parallel_edges_and_loops(people, direction, pairs):
    assert got(people.match("a", "Person").expand("a", "b", "KNOWS", direction).returns(p("a.name"), p("b.name"))) == pairs


def test_edge_properties_and_repeated_variables(people):
    hop = people.match("a", "Person").expand("a", "b", "KNOWS", edge="e", edge_where={"since": 2022})
    assert got(hop.returns(p("b.name"), p("e.since"))) == [("Carol", 2022)]
    assert got(people.match("a", "Person").expand("a", "b", "KNOWS", edge_where={"since": 2022}).returns(p("b.name"))) == [("Carol",)]
    assert got(people.match("a", "Person").expand("a", "a", "KNOWS").returns(p("a.name"))) == [("Bob",)]
    there_and_back = people.match("a", "Person", {"name": "Alice"}).expand("a", "b", "KNOWS").expand("b", "a", "KNOWS", "in")
    assert len(there_and_back.returns(p("b.name")).collect()) == 5
    same = people.match("a", "Person", {"name": "Alice"}).expand("a", "b", "KNOWS", edge="e").expand("b", "a", "KNOWS", "in", edge="e")
    assert len(same.returns(p("b.name")).collect()) == 3
    assert got(hop.match("e").returns(p("a.name"))) == []


def test_products_and_conditions(people):
    two = people.match("a", "Person").match("b", "Person")
    assert len(two.returns(p("a.name"), p("b.name")).collect()) == 16
    assert got(two.filter(p("a.age") < p("b.age")).filter(p("a.name") == "Bob").returns(p("b.name"))) == [("Alice",), ("Dan",)]
    assert got(people.match("a", "Person").match("b", "Person", on=p("a.age") > p("b.age")).filter(p("b.name") == "Bob").returns(p("a.name"))) == [("Alice",), ("Dan",)]
    assert len(people.match("a", "Person").match("a", "Other").returns(p("a.name")).collect()) == 0
    assert len(two.filter(v("a") == v("b")).returns(p("a.name")).collect()) == 4


def test_result_names_and_text(people):
    found = people.match("n", "Person", {"name": "Alice"}).returns(p("n.name"), p("n.name"), (p("n.age") > 3, "old"), 7, v("n"))
    assert found.columns == ["n.name", "n.name", "old", "expr", "n"]
    text = found.to_table()
    assert "Alice" in text and "label: Person" in text and "true" in text
    assert people.unit().returns().to_table() == "(no columns)"


def test_unknown_variables(people):
    with pytest.raises(PlanError):
        people.match("n", "Person").filter(p("m.age") > 1)
    with pytest.raises(PlanError):
        people.match("n", "Person").expand("m", "b")
    with pytest.raises(PlanError):
        people.match("n", "Person").set("m", "age", 1)
    with pytest.raises(PlanError):
        people.match("n", "Person").delete("m")
    with pytest.raises(PlanError):
        people.match("n", "Person").set("n", "self", v("n"))


def test_create(people):
    rows = people.unit().create_node("n", "Person", {"name": "Eve"})
    assert got(rows.returns(p("n.name"), p("n.age"))) == [("Eve", None)]
    assert len(people.match("n", "Person").returns(p("n.name")).collect()) == 4, "the old graph stays"
    each = people.match("a", "Person").create_node("pet", "Pet", {"owner": p("a.name")}).create_edge("a", "OWNS", "pet", {"since": 1}, edge="e")
    assert got(each.graph.match("x", "Pet").expand("x", "o", "OWNS", "in", edge="e").returns(p("x.owner"), p("o.name"), p("e.since"))) == [(n, n, 1) for n in ("Alice", "Bob", "Carol", "Dan")]
    ids = [r[0] for r in each.graph.scan_nodes().select("id").collect()]
    assert len(ids) == len(set(ids)) == 8
    assert len(people.match("n", "Person", {"name": "Zoe"}).create_node("x", "Pet").graph.scan_nodes("Pet").collect()) == 0
    lone = people.unit().create_edge("a", "LIKES", "b")
    assert len(lone.graph.scan_edges("LIKES").collect()) == 1 and len(lone.graph.scan_nodes().collect()) == 6


def test_merge(people):
    rows = people.match("a", "Person").merge_node("t", "Team", {"name": "red"})
    assert len(rows.graph.scan_nodes("Team").collect()) == 1
    assert len(rows.returns(p("t.name")).collect()) == 4
    again = rows.graph.unit().merge_node("t", "Team", {"name": "red"})
    assert len(again.graph.scan_nodes("Team").collect()) == 1
    ages = people.match("a", "Person").merge_node("x", "Age", {"n": p("a.age")})
    assert len(ages.graph.scan_nodes("Age").collect()) == 4, "a missing value is one value"


def test_set(people):
    changed = people.match("n", "Person").filter(p("n.age") > 25).set("n", "group", "old").graph
    assert got(changed.match("n", "Person").returns(p("n.name"), p("n.group"))) == [("Alice", "old"), ("Bob", None), ("Carol", None), ("Dan", "old")]
    after = people.match("n", "Person", {"name": "Bob"}).set("n", "age", 21)
    assert got(after.returns(p("n.age"))) == [(21,)]
    mixed = people.match("n", "Person", {"name": "Bob"}).set("n", "age", "young").graph
    ages = lambda c: got(mixed.match("n", "Person").filter(c).returns(p("n.name")))
    assert ages(p("n.age") == "young") == [("Bob",)] and ages(p("n.age") == 30) == [("Alice",)] and ages(p("n.age") > 30) == [("Dan",)]
    assert ages(p("n.age") <= 30) == [("Alice",), ("Bob",), ("Carol",)], "what has no order counts as equal in order"
    assert "young" in mixed.match("n", "Person", {"name": "Bob"}).returns(p("n.age")).to_table()
    back = mixed.match("n", "Person", {"name": "Bob"}).set("n", "age", 2.5).graph
    assert got(back.match("n", "Person").filter(p("n.age") < 10).returns(p("n.name"))) == [("Bob",), ("Carol",)]
    assert [r[0] for r in back.match("n", "Person").returns(p("n.name"), order_by=[p("n.age")]).collect()] == ["Carol", "Bob", "Alice", "Dan"]
    last = people.match("a", "Person", {"name": "Alice"}).match("b", "Person").set("a", "last", p("b.name")).graph
    assert got(last.match("n", "Person", {"name": "Alice"}).returns(p("n.last"))) == [("Dan",)], "the last row wins"
    edges = people.match("a", "Person").expand("a", "b", "KNOWS", edge="e", edge_where={"since": 2020}).set("e", "close", True).graph
    assert got(edges.match("a", "Person").expand("a", "b", "KNOWS", edge="e").filter(p("e.close")).returns(p("e.since"))) == [(2020,)]


def test_delete(people):
    with pytest.raises(ConstraintError):
        people.match("n", "Person", {"name": "Bob"}).delete("n")
    gone = people.match("n", "Person", {"name": "Bob"}).delete("n", detach=True)
    assert gone.returns(p("n.name")).collect() == []
    assert got(gone.graph.match("n", "Person").returns(p("n.name"))) == [("Alice",), ("Carol",), ("Dan",)]
    assert len(gone.graph.scan_edges("KNOWS").collect()) == 2
    assert len(people.match("n", "Person", {"name": "Dan"}).delete("n", "n").graph.scan_nodes().collect()) == 3
    fewer = people.match("a", "Person").expand("a", "b", "KNOWS", edge="e", edge_where={"since": 2021}).delete("e").graph
    assert sorted(r["since"] for r in fewer.scan_edges("KNOWS").collect()) == [2020, 2022, 2023]


def test_unique(people):
    held = people.with_unique("Person", "name").with_unique("Person", "name")
    assert held.has_unique("Person", "name") and held.indexes() == [("unique", "Person", "name")]
    with pytest.raises(ConstraintError):
        held.unit().create_node("n", "Person", {"name": "Bob"})
    with pytest.raises(ConstraintError):
        held.match("n", "Person").set("n", "name", "Bob")
    doubled = people.unit().create_node("n", "Person", {"name": "Bob"}).graph
    with pytest.raises(ConstraintError):
        doubled.with_unique("Person", "name")
    assert people.cluster_by("Person", "age").indexes() == [("clustered", "Person", "age")]


def test_store(spark, people, tmp_path):
    folder = str(tmp_path / "graph")
    with pytest.raises(StorageError):
        load(spark, folder)
    assert save(people.with_unique("Person", "name").cluster_by("Person", "age"), folder) == 1
    back = load(spark, folder)
    assert back.has_unique("Person", "name")
    assert len(back.match("a", "Person").expand("a", "b", "KNOWS").returns(p("b.name")).collect()) == 4
    bad = people.unit().create_node("n", "Person", {"name": "Bob"}).graph
    from dataclasses import replace

    with pytest.raises(ConstraintError):
        save(replace(bad, unique=frozenset({("Person", "name")})), folder)
    assert store.versions(spark, folder) == [1]
    assert save(back.match("n", "Person", {"name": "Dan"}).delete("n").graph, folder) == 2
    assert len(load(spark, folder).scan_nodes().collect()) == 3 and len(load(spark, folder, 1).scan_nodes().collect()) == 4
    with pytest.raises(StorageError):
        load(spark, folder, 9)


def test_neighbours(people):
    alice = people.match("n", "Person", {"name": "Alice"}).df.selectExpr("`n$id` AS id")
    assert [people.neighbours(alice, "KNOWS", d).count() for d in ("out", "in", "both")] == [3, 0, 3]
    bob = people.match("n", "Person", {"name": "Bob"}).df.selectExpr("`n$id` AS id")
    assert [people.neighbours(bob, None, d).count() for d in ("out", "in", "both")] == [1, 2, 2]
    dan = people.match("n", "Person", {"name": "Dan"}).df.selectExpr("`n$id` AS id")
    assert people.has_edges(bob.union(dan)).count() == 1
    assert (people.labels(), people.edge_types(), people.property_keys()) == (["Person"], ["KNOWS"], ["age", "k", "name", "since"])


def test_types_under_one_name(spark, people):
    other = people.with_nodes("Place", spark.createDataFrame([(1, 5)], "k int, name int"), "k")
    assert got(other.match("n").filter(p("n.name") == 5).returns(p("n.k"))) == [(1,)]
    assert len(other.match("n").filter(p("n.name") != 5).returns(p("n.k")).collect()) == 4
    made = other.unit().create_node("n", "Place", {"name": "x"}).graph
    assert got(made.match("n", "Place").filter(p("n.name") == "x").returns(p("n.k"))) == [(None,)]
    assert len(made.unit().merge_node("n", "Place", {"name": 5}).graph.scan_nodes("Place").collect()) == 2
    assert len(made.unit().merge_node("n", "Place", {"name": 5.0}).graph.scan_nodes("Place").collect()) == 3
    assert len(made.unit().merge_node("n", "Place", {"name": "x"}).graph.scan_nodes("Place").collect()) == 2


def test_ids_are_not_given_twice(spark, people, tmp_path):
    ids = lambda g, label: sorted(r[0] & ((1 << 48) - 1) for r in g.scan_nodes(label).select("id").collect())
    fewer = people.match("n", "Person", {"name": "Dan"}).delete("n").graph
    assert ids(fewer, "Person") == [1, 2, 3] and ids(fewer.unit().create_node("n", "Person").graph, "Person") == [1, 2, 3, 5]
    save(fewer, str(tmp_path / "g"))
    assert ids(load(spark, str(tmp_path / "g")).unit().create_node("n", "Person").graph, "Person") == [1, 2, 3, 5]
    none = people.match("a", "Person").expand("a", "b", "KNOWS", edge="e").delete("e").graph
    assert none.scan_edges("KNOWS").count() == 0
    linked = none.match("a", "Person", {"name": "Bob"}).create_edge("a", "KNOWS", "a").graph
    assert [r["id"] for r in linked.scan_edges("KNOWS").collect()] == [5]
    many = people.unit().graph.match("a", "Person").match("b", "Person").create_node("x", "Pair").graph
    low = ids(many, "Pair")
    assert low == [*range(low[0], low[0] + 16)], "no gaps, whatever the partitions"


def test_changes_leave_other_tables_alone(spark):
    from weftgraph import sales_graph

    g = sales_graph(spark, "/root/testdata/sf0.001")
    fewer = g.match("o", "Order").expand("o", "x", "CONTAINS", edge="l", edge_where={"returnflag": "R"}).delete("l").graph
    assert all(fewer.nodes[x] is g.nodes[x] for x in g.nodes) and [e.type for e in fewer.edges if e not in g.edges] == ["CONTAINS"]
    lines = g.scan_edges("CONTAINS").select("id")
    assert lines.distinct().count() == lines.count()
    text = g.match("n", "Nation").expand("n", "x", None, "both", edge="e", fetch=False).returns(p("x.label")).df._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in text and "part.parquet" not in text


def test_rows_of_several_files_have_ids_of_their_own(spark, tmp_path):
    from weftgraph.sources.tables import numbered_rows

    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t"))
    first, again = ([tuple(r) for r in numbered_rows(spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("id", "x") if i else spark.read.parquet(str(tmp_path / "t")).select(F.col("id").alias("x"))).collect()] for i in (0, 0))
    assert len({i for _, i in first}) == 100 and sorted(first) == sorted(again)


def test_two_savers_never_share_a_version(spark, people, tmp_path):
    folder = str(tmp_path / "g")
    assert [store.claimed(spark, folder) for _ in range(3)] == [1, 2, 3]
    assert save(people, folder) == 4 and store.versions(spark, folder) == [4]


def test_direct_reads(people):
    bob = people.match("n", "Person", {"name": "Bob"}).df.selectExpr("`n$id` AS id")
    assert [r["name"] for r in people.node(bob).collect()] == ["Bob"]
    assert sorted((r["key"], r["value"]) for r in people.properties(bob, "Person").collect()) == [("age", "20"), ("k", "2"), ("name", "Bob")]
    assert [r["since"] for r in people.edge(people.scan_edges().where("since = 2021").select("id"), "KNOWS").collect()] == [2021]


def test_stream_meets_graph(spark, people, tmp_path):
    spark.createDataFrame([(1, "hello"), (2, "bye"), (9, "nobody")], "k long, said string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, said string").parquet(str(tmp_path / "in"))
    rows = arriving(people, stream, "a", "Person", "k").expand("a", "b", "KNOWS").returns((p("a.said"), "said"), (p("b.name"), "name")).df
    query = rows.writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("heard").collect())) == [("bye", "Bob"), ("hello", "Bob"), ("hello", "Carol"), ("hello", "Carol")]


def test_hops_along_keys_need_one_join(spark):
    from weftgraph import sales_graph

    g = sales_graph(spark, "/root/testdata/sf0.001")
    plan = g.match("c", "Customer").expand("c", "o", "PLACED").filter(p("o.totalprice") > 1.0).returns(p("c.name"), p("o.orderkey")).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Join") == 1 and "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1.0)" in text.replace("IsNotNull(o_custkey), ", "")


def test_degrees_and_pairs_of_hops(people, spark):
    """Parallel edges count each, loops once; pairs of a hop's edges are the number squared, without a join of edges with edges."""
    key = lambda df: sorted((r["id"] % (1 << 48), r["n"]) for r in df.collect())
    assert key(people.degrees("KNOWS", "out")) == [(1, 3), (2, 1)]
    assert key(people.degrees("KNOWS", "in")) == [(2, 2), (3, 2)]
    assert key(people.degrees()) == [(1, 3), (2, 2), (3, 2)]
    pairs = QUERIES["chain_and_back_all"](spark, "/root/testdata/sf0.001")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_nodes_with_edges_meet_each_end_once(people, spark):
    ids = people.scan_nodes("Person").select("id")
    assert sorted(r[0] % (1 << 48) for r in people.has_edges(ids).collect()) == [1, 2, 3]
    assert sorted(r[0] % (1 << 48) for r in people.has_edges(ids, "Person").collect()) == [1, 2, 3]
    assert people.has_edges(ids, "Place").count() == 0
    plan = QUERIES["nodes_with_any_edge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in plan and "Relation [o_" not in plan and "Relation [c_" not in plan
