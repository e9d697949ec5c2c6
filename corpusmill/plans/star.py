"""Relational queries over the star schema: scans, joins, grouping, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table as t


def D(text: str):
    return F.lit(text).cast("timestamp")


def revenue():
    """Summed as decimals, so that the result does not depend on the order of rows."""
    return F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")


@query(
    "star_filter_project",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
)
def filter_project(spark, d):
    x = t(spark, d, "lineitem").filter(
        (
            F.col("l_shipdate") >= D("1996-01-01")
        ) & (F.col("l_shipdate") < D("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)
    )
    return x.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    "star_pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)
def pricing_summary(spark, d):
    x = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= D("1998-09-02"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), revenue().alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


@query(
    "star_shipping_priority",
    "SELECT o_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10",
)
def shipping_priority(spark, d):
    c = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t(spark, d, "orders").filter(F.col("o_orderdate") < D("1996-01-01")).select("o_orderkey", "o_custkey", "o_orderdate")
    x = c.join(o, c.c_custkey == o.o_custkey).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_orderkey", "o_orderdate").agg(revenue().alias("revenue")).orderBy(
        F.desc("revenue"), "o_orderkey"
    ).limit(10)


@query(
    "star_local_suppliers",
    "SELECT n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ALL",
)
def local_suppliers(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    x = t(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    x = x.join(
        t(spark, d, "customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    )
    return x.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), revenue().alias("revenue"))


for _kind, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():

    @query(
        f"star_join_{_kind}",
        f"SELECT count(*) AS n, CAST(count(c_custkey) AS BIGINT) AS customers, CAST(count(o_orderkey) AS BIGINT) AS orders, CAST(coalesce(sum(o_orderkey % 97), 0) AS BIGINT) AS mark FROM customer {_sql} (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey AND c_acctbal > 0",
    )
    def join_kind(spark, d, how=_kind):
        c, o = t(spark, d, "customer"), t(spark, d, "orders").filter("o_orderstatus = 'F'")
        x = c.join(o, (c.c_custkey == o.o_custkey) & (c.c_acctbal > 0), how)
        return x.agg(
            F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"),
            F.coalesce(F.sum(F.col("o_orderkey") % 97), F.lit(0)).alias("mark")
        )


@query(
    "star_join_semi",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"
)
def join_semi(spark, d):
    return t(spark, d, "customer").join(
        t(spark, d, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    ).select("c_custkey")


@query(
    "star_join_anti",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"
)
def join_anti(spark, d):
    return t(spark, d, "customer").join(
        t(spark, d, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"
    ).select("c_custkey")


@query("star_join_config_grid", "SELECT r_name, n_name, r_regionkey = n_regionkey AS own FROM region, nation")
def config_grid(spark, d):
    """Every pair of two dimension tables of fixed size (5 and 25 rows)."""
    return t(spark, d, "region").crossJoin(t(spark, d, "nation")).select(
        "r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own")
    )


@query(
    "star_join_range",
    "WITH bands AS (SELECT * FROM (VALUES (0, 1000.0, 'low'), (1, 1500.0, 'mid'), (2, 1e9, 'high')) b(i, hi, band)), b2 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY i), 0.0) AS lo FROM bands) SELECT band, count(*) AS n FROM part JOIN b2 ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band",
)
def join_range(spark, d):
    bands = spark.createDataFrame(
        [(0.0, 1000.0, "low"), (1000.0, 1500.0, "mid"), (1500.0, 1e9, "high")], "lo double, hi double, band string"
    )
    p = t(spark, d, "part")
    return p.join(
        F.broadcast(bands), (p.p_retailprice >= bands.lo) & (p.p_retailprice < bands.hi)
    ).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "star_join_asof",
    "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click') SELECT l.event_id, (SELECT max(struct_pack(ts := r.ts, id := r.click_id)).id FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS click_id FROM l",
)
def join_asof(spark, d):
    """The last click of the same user at or before each purchase: one window over the union, no join."""
    e = t(spark, d, "events").filter("event_type IN ('purchase', 'click')").select("event_id", "user_id", "ts", "event_type")
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    last = F.max(click).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return e.select(
        "event_id", "event_type", last["event_id"].alias("click_id")
    ).filter("event_type = 'purchase'").select("event_id", "click_id")


@query(
    "star_join_broadcast_hint",
    "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
)
def join_broadcast(spark, d):
    """nation has a fixed size of 25 rows."""
    return t(spark, d, "supplier").join(
        F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")
    ).groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


_GROUPED = "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY "


def _located(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def _measured(g):
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("star_group_by", _GROUPED + "r_name, n_name")
def group_by(spark, d):
    return _measured(_located(spark, d).groupBy("r_name", "n_name"))


@query("star_rollup", _GROUPED + "ROLLUP (r_name, n_name)")
def rollup(spark, d):
    return _measured(_located(spark, d).rollup("r_name", "n_name"))


@query("star_cube", _GROUPED + "CUBE (r_name, n_name)")
def cube(spark, d):
    return _measured(_located(spark, d).cube("r_name", "n_name"))


@query("star_grouping_sets", _GROUPED + "GROUPING SETS ((r_name), (n_name), ())")
def grouping_sets(spark, d):
    return _measured(_located(spark, d).groupingSets([["r_name"], ["n_name"], []], "r_name", "n_name"))


@query(
    "star_pivot",
    "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus"
)
def pivot(spark, d):
    x = t(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return x.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("star_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(
    "star_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag"
)
def count_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query(
    "star_percentiles",
    "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM part GROUP BY p_brand"
)
def percentiles(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.round(F.percentile("p_retailprice", 0.5), 4).alias("median"),
        F.round(F.percentile("p_retailprice", 0.9), 4).alias("p90")
    )


@query("star_approx_distinct")
def approx_distinct(spark, d):
    """HyperLogLog counts: within the sketch's error of star_count_distinct, so there is no equal SQL."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("suppliers")
    )


@query(
    "star_rankings",
    "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal / 100) AS BIGINT) DESC)",
)
def rankings(spark, d):
    coarse = Window.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 100).desc())
    fine = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t(spark, d, "customer").select(
        "c_custkey", F.rank().over(coarse).alias("r"), F.dense_rank().over(coarse).alias("dr"),
        F.row_number().over(fine).alias("rn"), F.ntile(4).over(fine).alias("quarter")
    )


@query(
    "star_lag_lead",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey, 2) OVER w AS after_next, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def lag_lead(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey", 2).over(w).alias("after_next"),
        F.first("o_orderkey").over(w).alias("first")
    )


@query(
    "star_frames",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM orders",
)
def frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("last3")
    )


@query(
    "star_top_per_group",
    "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3"
)
def top_per_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", rank.alias("r")).filter("r <= 3").drop("r")


@query("star_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


for _name, _op, _f in (
    ("union_all", "UNION ALL", lambda a, b: a.unionByName(b)), ("union", "UNION", lambda a, b: a.unionByName(b).distinct()), ("intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)), ("except", "EXCEPT", lambda a, b: a.subtract(b)), ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
):

    @query(
        f"star_{_name}",
        f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000 {_op} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000"
    )
    def set_operation(spark, d, f=_f):
        orders = t(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
        return f(orders, t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query(
    "star_scalar_subquery",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"
)
def scalar_subquery(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice")
    mean = p.agg(F.avg("p_retailprice").alias("mean"))  # one row
    return p.join(F.broadcast(mean), F.col("p_retailprice") > F.col("mean")).drop("mean")


@query(
    "star_having",
    "SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250"
)
def having(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q > 250").select(
        "l_orderkey", F.round("q", 2).alias("quantity")
    )


@query(
    "star_case_expression",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS size FROM orders"
)
def case_expression(spark, d):
    p = F.col("o_totalprice")
    return t(spark, d, "orders").select(
        "o_orderkey", F.when(p < 50000, "small").when(p < 200000, "medium").otherwise("large").alias("size")
    )


@query(
    "star_recursive_reach",
    "WITH RECURSIVE r(n, depth) AS (SELECT 0, 0 UNION SELECT n_nationkey, depth + 1 FROM r JOIN nation ON n_nationkey = (n * 2 + 1) % 25 WHERE depth < 4) SELECT n, depth FROM r",
)
def recursive_reach(spark, d):
    """Rounds over a frontier, as in a link crawl of bounded depth."""
    n = t(spark, d, "nation").select("n_nationkey")
    edge = spark.createDataFrame([(0,)], "n int").withColumn("depth", F.lit(0))
    out = edge
    for k in range(4):
        edge = n.join(edge, F.col("n_nationkey") == (F.col("n") * 2 + 1) % 25).select(
            F.col("n_nationkey").alias("n"), F.lit(k + 1).alias("depth")
        )
        out = out.unionByName(edge)
    return out.distinct()
