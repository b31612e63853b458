"""Generic families on the supplied tables: joins, set operations, orders, pages, facets (J, U, O, G)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("j1_left_two_keys", "SELECT l.l_orderkey, l.l_suppkey, count(*) AS n, CAST(coalesce(max(m.m), 0) AS DOUBLE) AS best FROM lineitem l LEFT JOIN (SELECT l_suppkey, l_linenumber, max(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) m ON l.l_suppkey = m.l_suppkey AND l.l_linenumber = m.l_linenumber GROUP BY 1, 2")
def j1(spark, d):
    li = _t(spark, d, "lineitem")
    m = li.where("l_returnflag = 'R'").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("m"))
    return li.select("l_orderkey", "l_suppkey", "l_linenumber").join(m, ["l_suppkey", "l_linenumber"], "left").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("m"), F.lit(0.0)).alias("best"))


@query("j2_inner_renamed_keys", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j2(spark, d):
    met = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j4_groups_with_many", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 3")
def j4(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers")).where("suppliers > 3")


@query("j8_scalar_cross", "WITH s AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), any_value(last)) AS BIGINT) AS idle_days FROM orders, s GROUP BY 1")
def j8(spark, d):
    o = _t(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = o.agg(F.max("day").alias("last"))  # one row
    each = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("day"))
    return each.join(F.broadcast(last)).select("o_custkey", "n", F.datediff("last", "day").cast("bigint").alias("idle_days"))


@query("j15_state_as_of", """WITH f AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS frame), s AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
 SELECT frame, event_type, count(*) AS users FROM f JOIN s ON s.ts <= f.frame AND (s.nx IS NULL OR s.nx > f.frame) GROUP BY 1, 2""")
def j15(spark, d):
    e = _t(spark, d, "events").withColumn("nx", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    # Each state is exploded to the frames of its validity; no range join is left.
    first = F.greatest(F.date_trunc("day", "ts").cast("timestamp_ntz") + F.when(F.date_trunc("day", "ts").cast("timestamp_ntz") == F.col("ts"), F.expr("interval 0 day")).otherwise(F.expr("interval 1 day")), F.lit("2024-01-02").cast("timestamp_ntz"))
    last = F.coalesce(F.date_trunc("day", F.col("nx") - F.expr("interval 1 microsecond")).cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz"))
    held = e.select("event_type", first.alias("a"), F.least(last, F.lit("2024-01-30").cast("timestamp_ntz")).alias("b")).where("a <= b")
    return held.select("event_type", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("frame")).groupBy("frame", "event_type").agg(F.count(F.lit(1)).alias("users"))


@query("g1_conditional_counts", "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS open_lines, round(avg(CASE WHEN l_discount > 0.05 THEN l_quantity END), 6) AS avg_discounted, round(median(l_quantity), 6) AS median_quantity FROM lineitem GROUP BY 1")
def g1(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 6).alias("avg_discounted"), F.round(F.median("l_quantity"), 6).alias("median_quantity")
    )


@query("g9_ordered_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, array_to_string(list_sort(list(DISTINCT o_orderpriority))[1:2], ',') AS sample FROM orders GROUP BY 1")
def g9(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 2), ",").alias("sample"))


@query("g17_concentration", "WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_partkey) AS share FROM c) SELECT l_partkey, round(sum(share * share), 6) AS hhi FROM s GROUP BY 1")
def g17(spark, d):
    c = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_partkey")))
    return c.groupBy("l_partkey").agg(F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"))


@query("g19_keep_last", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def g19(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("g22_facets", "SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def g22(spark, d):
    facets = _t(spark, d, "orders").select(F.explode(F.array(F.struct(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("facet"), F.col("o_orderpriority").alias("value")))).alias("x"))
    return facets.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query("u1_union_all", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1")
def u1(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).unionAll(_t(spark, d, "customer").select("c_custkey")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("u2_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u2(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(_t(spark, d, "customer").select("c_custkey")).distinct()


@query("u4_difference", "SELECT 'removed' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def u4(spark, d):
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(o, "k", "left_anti").select(F.lit("removed").alias("side"), "k").unionAll(c.join(o, "k", "left_semi").select(F.lit("both"), "k"))


def page(df, order: list, limit: int, offset: int = 0, most: int = 500):
    """One page of a totally ordered result."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


@query("o1_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def o1(spark, d):
    return page(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, 50)


@query("o3_top_k", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY round(sum(l_extendedprice), 2) DESC, l_suppkey LIMIT 10")
def o3(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_suppkey").limit(10)


@query("o7_top_per_group", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) SELECT o_custkey, o_orderkey, CAST(greatest(0, c - 3) AS BIGINT) AS hidden FROM r WHERE k <= 3")
def o7(spark, d):
    w = Window.partitionBy("o_custkey")
    ranked = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("k"), F.count(F.lit(1)).over(w).alias("c"))
    return ranked.where("k <= 3").select("o_custkey", "o_orderkey", F.greatest(F.lit(0), F.col("c") - 3).cast("bigint").alias("hidden"))
