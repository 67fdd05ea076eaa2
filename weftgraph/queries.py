"""The graph queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import ConstraintError
from weftgraph.functions.expressions import p, v
from weftgraph.sources.folders import shared_folder
from weftgraph.sources.graph import Graph
from weftgraph.sources.store import load, save
from weftgraph.sources.tables import sales_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


OPEN: dict[tuple[str, str], Graph] = {}


def opened(spark: SparkSession, folder: str) -> Graph:
    """The folder's graph, opened once for an application: later queries start from its table definitions."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in OPEN:
        OPEN.clear()
        OPEN[key] = sales_graph(spark, folder)
    return OPEN[key]


def query(sql: str | None):
    """Registers a function of a graph; ``sql`` gives the same rows."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(opened(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- scans, projections, filters ----


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer")
def scan_label(g):
    return g.match("c", "Customer").returns((p("c.custkey"), "custkey"), (p("c.name"), "name")).df


@query("SELECT n_nationkey::BIGINT AS nationkey FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7)")
def scan_inline_property(g):
    name = g.match("n", "Nation", {"nationkey": 7}).returns(p("n.name")).collect()[0][0]
    return g.match("n", "Nation", {"name": name}).returns((p("n.nationkey"), "nationkey")).df


@query("SELECT count(*) AS n FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM part UNION ALL SELECT 1 FROM orders UNION ALL SELECT 1 FROM events)")
def scan_all_nodes(g):
    return g.scan_nodes().agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM orders UNION ALL SELECT 1 FROM lineitem UNION ALL SELECT 1 FROM lineitem)")
def scan_all_edges(g):
    return g.scan_edges().agg(F.count("*").alias("n"))


@query("SELECT 'x' AS name WHERE false")
def scan_unknown_label(g):
    return g.match("x", "Nobody").returns((p("x.name"), "name")).df.select(F.col("name").cast("string").alias("name"))


def _comparison(name: str, condition, sql: str) -> None:
    @query(f"SELECT p_partkey AS partkey, p_size::BIGINT AS size FROM part WHERE {sql}")
    def compared(g):
        return g.match("x", "Part").filter(condition).returns((p("x.partkey"), "partkey"), (p("x.size"), "size")).df

    QUERIES[name], ORACLES[name] = QUERIES.pop("compared"), ORACLES.pop("compared")


_comparison("filter_equal", p("x.size") == 15, "p_size = 15")
_comparison("filter_not_equal", p("x.size") != 15, "p_size <> 15 OR p_size IS NULL")
_comparison("filter_less", p("x.size") < 15, "p_size < 15 OR p_size IS NULL")
_comparison("filter_at_most", p("x.size") <= 15, "p_size <= 15 OR p_size IS NULL")
_comparison("filter_greater", p("x.size") > 15, "p_size > 15")
_comparison("filter_at_least", p("x.size") >= 15, "p_size >= 15")
_comparison("filter_and_or_not", (p("x.size") > 40) | (p("x.size") < 10) & ~(p("x.brand") == "Brand#13"), "p_size > 40 OR (p_size < 10 AND NOT p_brand = 'Brand#13')")
_comparison("filter_missing_less", (p("x.nothing") < 3) & (p("x.size") == 1), "p_size = 1")
_comparison("filter_missing_not_equal", (p("x.nothing") != 3) & (p("x.size") == 1), "p_size = 1")
_comparison("filter_missing_greater", p("x.nothing") > 3, "false")
_comparison("filter_missing_equal", (p("x.nothing") == None) & (p("x.size") == 2), "p_size = 2")  # noqa: E711
_comparison("filter_whole_equals_floating", p("x.size") == 15.0, "false")
_comparison("filter_whole_against_floating", p("x.size") < 14.5, "p_size < 14.5")
_comparison("filter_mixed_types_at_most", (p("x.brand") <= 3) & (p("x.size") == 3), "p_size = 3")
_comparison("filter_mixed_types_less", p("x.brand") < 3, "false")


@query("SELECT p_partkey AS partkey, p_retailprice > 1500 AS dear FROM part")
def project_comparison(g):
    return g.match("x", "Part").returns((p("x.partkey"), "partkey"), (p("x.retailprice") > 1500.0, "dear")).df


@query("SELECT 42::BIGINT AS answer")
def return_literal(g):
    return g.unit().returns((42, "answer")).df


@query("SELECT r_regionkey::BIGINT AS id, 'Region' AS label, r_name AS name FROM region")
def return_whole_node(g):
    whole = g.match("r", "Region").returns(v("r")).df
    return whole.select(F.col("r.properties.regionkey").alias("id"), "r.label", F.col("r.properties.name").alias("name"))


@query("SELECT 'PLACED' AS type, o_custkey AS custkey, o_orderkey AS orderkey FROM orders")
def return_whole_edge(g):
    found = g.match("c", "Customer").expand("c", "o", "PLACED", edge="e").returns(v("e"), (p("c.custkey"), "custkey"), (p("o.orderkey"), "orderkey")).df
    return found.select("e.type", "custkey", "orderkey")


@query("SELECT * FROM (SELECT n_name AS a, n_nationkey::BIGINT AS b FROM nation)")
def return_renamed_twice(g):
    return g.match("n", "Nation").returns(p("n.name"), p("n.nationkey")).df.toDF("a", "b")


# ---- order and slices ----


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(g):
    return g.match("o", "Order").returns((p("o.orderkey"), "orderkey"), (p("o.totalprice"), "price"), order_by=[(p("o.totalprice"), "desc"), p("o.orderkey")], limit=25).df


@query("SELECT c_custkey AS custkey FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 10 OFFSET 5")
def skip_limit(g):
    return g.match("c", "Customer").returns((p("c.custkey"), "custkey"), order_by=[p("c.mktsegment"), (p("c.custkey"), "desc")], skip=5, limit=10).df


@query("SELECT n_nationkey::BIGINT AS nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def skip_only(g):
    return g.match("n", "Nation").returns((p("n.nationkey"), "nationkey"), order_by=[p("n.nationkey")], skip=20).df


@query("SELECT p_partkey AS partkey FROM part ORDER BY p_partkey LIMIT 7")
def limit_in_creation_order(g):
    return g.match("x", "Part").returns((p("x.partkey"), "partkey"), limit=7).df


# ---- hops ----


@query("SELECT c_name AS name, o_orderkey AS orderkey, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def flagship(g):
    placed = g.match("c", "Customer", {"mktsegment": "BUILDING"}).expand("c", "o", "PLACED").filter(p("o.totalprice") > 100000.0)
    return placed.returns((p("c.name"), "name"), (p("o.orderkey"), "orderkey"), (p("o.totalprice"), "price"), order_by=[(p("o.totalprice"), "desc"), p("o.orderkey")], limit=20).df


@query("SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_out(g):
    return g.match("c", "Customer").expand("c", "n", "IN_NATION").returns((p("c.custkey"), "custkey"), (p("n.name"), "nation")).df


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
def expand_in(g):
    return g.match("r", "Region").expand("r", "n", "IN_REGION", "in").returns((p("r.name"), "region"), (p("n.name"), "nation")).df


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def expand_both(g):
    return g.match("n", "Nation").expand("n", "r", "IN_REGION", "both").returns((p("n.name"), "nation"), (p("r.name"), "region")).df


@query("SELECT type, count(*) AS n FROM (SELECT 'IN_REGION' AS type FROM nation UNION ALL SELECT 'IN_NATION' FROM customer UNION ALL SELECT 'BASED_IN' FROM supplier) GROUP BY type")
def expand_any_type(g):
    found = g.match("n", "Nation").expand("n", "x", None, "both", edge="e", fetch=False).returns((p("e.type"), "type")).df
    return found.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS orderkey, p_name AS part, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49")
def expand_edge_properties(g):
    found = g.match("o", "Order").expand("o", "x", "CONTAINS", edge="l").filter(p("l.quantity") > 49.0)
    return found.returns((p("o.orderkey"), "orderkey"), (p("x.name"), "part"), (p("l.quantity"), "quantity")).df


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1")
def expand_edge_map(g):
    found = g.match("o", "Order").expand("o", "x", "CONTAINS", edge_where={"returnflag": "R", "linenumber": 1})
    return found.returns((p("o.orderkey"), "orderkey"), (p("x.partkey"), "partkey")).df


@query("SELECT p_partkey AS partkey, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000 GROUP BY 1")
def expand_target_filter(g):
    found = g.match("x", "Part").expand("x", "s", "SUPPLIES", "in").filter(p("s.acctbal") > 5000.0)
    return found.returns((p("x.partkey"), "partkey")).df.groupBy("partkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_two(g):
    return g.match("c", "Customer").expand("c", "n", "IN_NATION").expand("n", "r", "IN_REGION").returns((p("c.custkey"), "custkey"), (p("r.name"), "region")).df


@query("SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def chain_four(g):
    found = g.match("r", "Region").expand("r", "n", "IN_REGION", "in").expand("n", "c", "IN_NATION", "in").expand("c", "o", "PLACED").expand("o", "x", "CONTAINS", fetch=False)
    return found.returns((p("r.name"), "region")).df.groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT a.l_orderkey AS first_order, b.l_orderkey AS other_order FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN part ON p_partkey = a.l_partkey WHERE p_size = 1 AND p_partkey < 500")
def chain_and_back(g):
    found = g.match("x", "Part", {"size": 1}).filter(p("x.partkey") < 500).expand("x", "a", "CONTAINS", "in").expand("x", "b", "CONTAINS", "in")
    return found.returns((p("a.orderkey"), "first_order"), (p("b.orderkey"), "other_order")).df


@query("SELECT a.l_partkey AS partkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN part ON p_partkey = a.l_partkey GROUP BY a.l_partkey")
def chain_and_back_all(g):
    """The hop of ``chain_and_back`` over every part, as pairs a part: each of its edges with each, so their number squared."""
    edges = g.degrees("CONTAINS", "in")
    return g.scan_nodes("Part").join(edges, "id").groupBy("partkey").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))


@query("SELECT c_custkey AS custkey, s_suppkey AS suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
def meet_at_a_node(g):
    found = g.match("c", "Customer").filter(p("c.acctbal") > 9000.0).expand("c", "n", "IN_NATION").expand("n", "s", "BASED_IN", "in")
    return found.returns((p("c.custkey"), "custkey"), (p("s.suppkey"), "suppkey")).df


@query("SELECT o_orderkey AS orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE false")
def edge_is_no_node(g):
    found = g.match("c", "Customer").expand("c", "o", "PLACED", edge="e").match("e")
    return found.returns((p("o.orderkey"), "orderkey")).df


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey FROM lineitem WHERE l_tax = 0.08 AND l_quantity = 50")
def same_edge_again(g):
    found = g.match("o", "Order").expand("o", "x", "CONTAINS", edge="l", edge_where={"tax": 0.08, "quantity": 50.0}).expand("x", "o", "CONTAINS", "in", edge="l")
    return found.returns((p("o.orderkey"), "orderkey"), (p("x.partkey"), "partkey")).df


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def product_of_two(g):
    return g.match("a", "Region").match("b", "Region").returns((p("a.name"), "a"), (p("b.name"), "b")).df


@query("SELECT s_suppkey AS suppkey, r_name AS region FROM supplier, region WHERE s_suppkey < r_regionkey")
def theta_join(g):
    return g.match("s", "Supplier").match("r", "Region", on=p("s.suppkey") < p("r.regionkey")).returns((p("s.suppkey"), "suppkey"), (p("r.name"), "region")).df


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def equal_properties_join(g):
    found = g.match("a", "Supplier").match("b", "Supplier").filter((p("a.nationkey") == p("b.nationkey")) & (p("a.suppkey") < p("b.suppkey")))
    return found.returns((p("a.suppkey"), "a"), (p("b.suppkey"), "b")).df


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def neighbours(g):
    nations = g.match("n", "Nation", {"regionkey": 1}).df.select(F.col("n$id").alias("id"))
    around = g.neighbours(nations, "IN_NATION", "in")
    return around.select((F.col("neighbour") % (1 << 48)).alias("id"))


@query("SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def nodes_with_orders(g):
    customers = g.scan_nodes("Customer")
    orders = g.scan_edges("PLACED").select(F.col("src").alias("id"))
    return customers.join(orders, "id", "left_semi").select("custkey")


# ---- changes ----


@query("SELECT n_name AS name FROM nation UNION ALL SELECT 'Atlantis'")
def create_then_match(g):
    changed = g.unit().create_node("n", "Nation", {"name": "Atlantis", "nationkey": 99}).graph
    return changed.match("n", "Nation").returns((p("n.name"), "name")).df


@query("SELECT r_name AS name, 'copy of ' || r_name AS made FROM region WHERE false UNION ALL SELECT r_name, 'new' FROM region")
def create_for_each_row(g):
    rows = g.match("r", "Region").create_node("x", "Mark", {"name": p("r.name"), "made": "new"})
    return rows.returns((p("x.name"), "name"), (p("x.made"), "made")).df


@query("SELECT s_suppkey AS suppkey, n_name AS nation, 2024::BIGINT AS since FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def create_edges(g):
    rows = g.match("n", "Nation", {"regionkey": 2}).expand("n", "s", "BASED_IN", "in").create_edge("n", "HOSTS", "s", {"since": 2024})
    found = rows.graph.match("n", "Nation").expand("n", "s", "HOSTS", edge="e")
    return found.returns((p("s.suppkey"), "suppkey"), (p("n.name"), "nation"), (p("e.since"), "since")).df


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def merge_distinct(g):
    changed = g.match("c", "Customer").merge_node("s", "Segment", {"name": p("c.mktsegment")}).graph
    return changed.scan_nodes("Segment").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer")
def merge_binds_rows(g):
    rows = g.match("c", "Customer").merge_node("s", "Segment", {"name": p("c.mktsegment")})
    return rows.returns((p("c.custkey"), "custkey"), (p("s.name"), "segment")).df


@query("SELECT count(*) AS n FROM region")
def merge_existing(g):
    names = [r[0] for r in g.match("r", "Region").returns(p("r.name")).collect()]
    changed = g.unit().merge_node("r", "Region", {"name": names[0]}).graph
    return changed.scan_nodes("Region").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS acctbal FROM supplier")
def set_literal(g):
    changed = g.match("s", "Supplier").filter(p("s.acctbal") < 0.0).set("s", "acctbal", 0.0).graph
    return changed.match("s", "Supplier").returns((p("s.suppkey"), "suppkey"), (p("s.acctbal"), "acctbal")).df


@query("SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def set_from_other(g):
    rows = g.match("c", "Customer").expand("c", "n", "IN_NATION").set("c", "nation", p("n.name"))
    return rows.graph.match("c", "Customer").returns((p("c.custkey"), "custkey"), (p("c.nation"), "nation")).df


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey, CASE WHEN l_quantity = 50 THEN 'full' END AS note FROM lineitem")
def set_on_edges(g):
    changed = g.match("o", "Order").expand("o", "x", "CONTAINS", edge="l", edge_where={"quantity": 50.0}).set("l", "note", "full").graph
    found = changed.match("o", "Order").expand("o", "x", "CONTAINS", edge="l")
    return found.returns((p("o.orderkey"), "orderkey"), (p("x.partkey"), "partkey"), (p("l.note"), "note")).df


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey FROM lineitem WHERE l_returnflag <> 'R'")
def delete_edges(g):
    changed = g.match("o", "Order").expand("o", "x", "CONTAINS", edge="l", edge_where={"returnflag": "R"}).delete("l").graph
    return changed.match("o", "Order").expand("o", "x", "CONTAINS").returns((p("o.orderkey"), "orderkey"), (p("x.partkey"), "partkey")).df


@query("SELECT p_partkey AS partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size <> 1 GROUP BY 1 HAVING count(l_orderkey) > 0")
def detach_delete(g):
    changed = g.match("x", "Part", {"size": 1}).delete("x", detach=True).graph
    found = changed.match("o", "Order").expand("o", "x", "CONTAINS", fetch=True)
    return found.returns((p("x.partkey"), "partkey")).df.groupBy("partkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, c_nationkey = 3 AS gone FROM customer WHERE c_nationkey = 3 OR c_nationkey = 4")
def detach_delete_key_edges(g):
    changed = g.match("n", "Nation", {"nationkey": 3}).delete("n", detach=True).graph
    kept = g.match("c", "Customer").filter((p("c.nationkey") == 3) | (p("c.nationkey") == 4)).returns((p("c.custkey"), "custkey")).df
    after = changed.scan_nodes("Customer").select("custkey", F.col("nationkey").isNull().alias("gone"))
    return kept.join(after, "custkey")


@query("SELECT 'refused' AS outcome")
def delete_refused(g):
    try:
        g.match("n", "Nation", {"nationkey": 3}).delete("n")
        outcome = "deleted"
    except ConstraintError:
        outcome = "refused"
    return g.spark.createDataFrame([(outcome,)], "outcome string")


@query("SELECT 'violated' AS outcome")
def unique_violated(g):
    held = g.with_unique("Nation", "name").with_unique("Nation", "name")
    name = held.match("n", "Nation", {"nationkey": 1}).returns(p("n.name")).collect()[0][0]
    try:
        held.unit().create_node("n", "Nation", {"name": name})
        outcome = "created"
    except ConstraintError:
        outcome = "violated"
    return g.spark.createDataFrame([(outcome,)], "outcome string")


@query("SELECT max(r_regionkey)::BIGINT + 1 AS id FROM region")
def create_after_delete(g):
    """An id is not given again, even of the newest node."""
    last = g.scan_nodes("Region").agg(F.max("regionkey")).first()[0]
    fewer = g.match("r", "Region", {"regionkey": last}).delete("r", detach=True).graph
    made = fewer.unit().create_node("x", "Region", {"name": "NEW"}).returns((p("x.id"), "id")).df
    return made.select((F.col("id") % (1 << 48)).alias("id"))


# ---- direct reads, the catalog, and what else has no step of its own ----


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_nationkey = 3")
def nodes_by_id(g):
    ids = g.scan_nodes("Customer").where("nationkey = 3").select("id")
    return g.node(ids).select("custkey", "name")


@query("SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_quantity AS quantity FROM lineitem WHERE l_quantity = 50")
def edges_by_id(g):
    ids = g.scan_edges("CONTAINS").where("quantity = 50").select("id")
    return g.edge(ids, "CONTAINS").select((F.col("src") % (1 << 48)).alias("orderkey"), (F.col("dst") % (1 << 48)).alias("partkey"), "quantity")


@query("SELECT r_regionkey::BIGINT AS id, 'name' AS key, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'regionkey', r_regionkey::VARCHAR FROM region")
def stored_properties(g):
    found = g.properties(g.scan_nodes("Region").select("id"), "Region").where("key in ('name', 'regionkey')")
    return found.select((F.col("id") % (1 << 48)).alias("id"), "key", "value")


@query("SELECT 'Nation' AS label, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'Customer', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey = 3")
def property_of_any_label(g):
    return g.match("x", None, {"nationkey": 3}).returns((p("x.label"), "label")).df.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def nodes_with_any_edge(g):
    parts = g.scan_nodes("Part").select("id")
    return g.has_edges(parts, "Part").select((F.col("id") % (1 << 48)).alias("partkey"))


@query("SELECT n_name AS nation, s_suppkey AS suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def expand_to_a_label(g):
    found = g.match("n", "Nation").expand("n", "x", None, "in", label="Supplier")
    return found.returns((p("n.name"), "nation"), (p("x.suppkey"), "suppkey")).df


@query("SELECT 'Nation' AS near, x AS far, count(*) AS n FROM (SELECT 'Region' AS x FROM nation UNION ALL SELECT 'Customer' FROM customer UNION ALL SELECT 'Supplier' FROM supplier) GROUP BY x")
def labels_of_neighbours(g):
    found = g.match("n", "Nation").expand("n", "x", None, "both").filter(p("x.name") != "nobody")
    return found.returns((p("n.label"), "near"), (p("x.label"), "far")).df.groupBy("near", "far").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS partkey, CASE WHEN p_size >= 25 THEN p_brand END AS grade FROM part ORDER BY grade NULLS FIRST, p_partkey LIMIT 60")
def order_with_missing(g):
    graded = g.match("x", "Part").filter(p("x.size") >= 25).set("x", "grade", p("x.brand")).graph
    return graded.match("x", "Part").returns((p("x.partkey"), "partkey"), (p("x.grade"), "grade"), order_by=[p("x.grade"), p("x.partkey")], limit=60).df


@query("SELECT p_partkey AS partkey, CASE WHEN p_size >= 49 THEN p_brand END AS grade FROM part ORDER BY grade DESC NULLS LAST, p_partkey DESC LIMIT 60")
def order_with_missing_last(g):
    graded = g.match("x", "Part").filter(p("x.size") >= 49).set("x", "grade", p("x.brand")).graph
    return graded.match("x", "Part").returns((p("x.partkey"), "partkey"), (p("x.grade"), "grade"), order_by=[(p("x.grade"), "desc"), (p("x.partkey"), "desc")], limit=60).df


@query("SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000")
def filter_by_a_boolean(g):
    told = g.match("c", "Customer").set("c", "rich", p("c.acctbal") > 5000.0).graph
    return told.match("c", "Customer").filter(p("c.rich")).returns((p("c.custkey"), "custkey")).df


@query("SELECT p_partkey AS partkey, CASE WHEN p_size < 5 THEN 'whole' WHEN p_size < 10 THEN 'floating' ELSE 'text' END AS kind FROM part WHERE p_size IS NOT NULL")
def values_of_several_types(g):
    """Brands that are numbers in some parts: each value is equal and ordered by its own type."""
    changed = g.match("x", "Part").filter((p("x.size") < 5) & (p("x.size") >= 0)).set("x", "brand", 7).graph
    changed = changed.match("x", "Part").filter((p("x.size") >= 5) & (p("x.size") < 10)).set("x", "brand", 7.5).graph
    kinds = {"whole": p("x.brand") == 7, "floating": (p("x.brand") > 7) & (p("x.brand") < 8), "text": p("x.brand") > ""}
    found = [changed.match("x", "Part").filter(c).returns((p("x.partkey"), "partkey"), (k, "kind")).df for k, c in kinds.items()]
    return found[0].union(found[1]).union(found[2])


@query('SELECT n_name AS "n.name", n_nationkey::BIGINT AS "n.nationkey", n_nationkey > 5 AS expr FROM nation')
def names_of_columns(g):
    return g.match("n", "Nation").returns(p("n.name"), p("n.nationkey"), p("n.nationkey") > 5).df


@query("SELECT i, CASE i % 2 WHEN 1 THEN '+' || repeat('-', w + 2) || '+' ELSE '| ' || rpad(CASE i WHEN 2 THEN 'r.name' ELSE name END, w, ' ') || ' |' END AS line FROM (SELECT r_name AS name, greatest(length(r_name), 6)::INTEGER AS w FROM region WHERE r_regionkey = 1), (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS i)")
def result_as_text(g):
    text = g.match("r", "Region", {"regionkey": 1}).returns(p("r.name")).to_table()
    return g.spark.createDataFrame([*enumerate(text.split("\n"), 1)], "i long, line string")


@query("SELECT * FROM (VALUES ('label', 'Customer'), ('label', 'Event'), ('label', 'Nation'), ('label', 'Order'), ('label', 'Part'), ('label', 'Region'), ('label', 'Supplier'), ('type', 'BASED_IN'), ('type', 'CONTAINS'), ('type', 'IN_NATION'), ('type', 'IN_REGION'), ('type', 'PLACED'), ('type', 'SUPPLIES'), ('key', 'mktsegment'), ('key', 'returnflag')) AS t(kind, name)")
def names_in_the_catalog(g):
    keys = [k for k in g.property_keys() if k in ("mktsegment", "returnflag")]
    rows = [("label", x) for x in g.labels()] + [("type", x) for x in g.edge_types()] + [("key", x) for x in keys]
    return g.spark.createDataFrame(rows, "kind string, name string")


def _stored(g: Graph) -> Graph:
    """Nations and regions with a unique and a clustered property, saved and loaded."""
    small = Graph(g.spark).with_nodes("Region", g.table("Region").df).with_nodes("Nation", g.table("Nation").df)
    edges = g.scan_edges("IN_REGION").select("id", "src", "dst", F.lit("part of").alias("how"))
    small = small.with_edges("IN_REGION", edges, "Nation", "Region").with_unique("Region", "name").cluster_by("Nation", "name")
    folder = f"{shared_folder(g.spark)}/graph-{uuid.uuid4().hex}"
    save(small, folder)
    return load(g.spark, folder)


@query("SELECT n_name AS nation, r_name AS region, 'part of' AS how FROM nation JOIN region ON n_regionkey = r_regionkey")
def saved_and_loaded(g):
    found = _stored(g).match("n", "Nation").expand("n", "r", "IN_REGION", edge="e")
    return found.returns((p("n.name"), "nation"), (p("r.name"), "region"), (p("e.how"), "how")).df


@query("SELECT * FROM (VALUES ('unique', 'Region', 'name'), ('clustered', 'Nation', 'name')) AS t(kind, label, key)")
def indexes_after_loading(g):
    return g.spark.createDataFrame(_stored(g).indexes(), "kind string, label string, key string")


@query("SELECT true AS reads_parquet, false AS joins")
def explained_plan(g):
    """Of a filter on one label: what the physical plan, as ``explain`` shows it, says."""
    plan = g.match("x", "Part", {"size": 1}).returns(p("x.name")).df._jdf.queryExecution().toString()
    return g.spark.createDataFrame([("FileScan parquet" in plan and "PushedFilters: [IsNotNull(p_size)" in plan, "Join" in plan)], "reads_parquet boolean, joins boolean")
