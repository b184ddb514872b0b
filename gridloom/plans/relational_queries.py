"""Queries of requests, joins, sets, reshaping and coverage over the star schema and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.functions.scalar import either, row_sum, whole_label
from gridloom.operators import coverage, features, forecast, fuzzy, series
from gridloom.plans.base import Book, Tables
from gridloom.sources import readers
from gridloom.sources import requests as Q

book = Book()

BOUNDS_SQL = "b AS (SELECT o_orderstatus AS code, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1)"


def bounds(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("code")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))


@book.add(
    f"""WITH {BOUNDS_SQL}, p AS (SELECT code, s, e, unnest(generate_series(CASE WHEN s = date_trunc('month', s) THEN s ELSE date_trunc('month', s) + INTERVAL 1 MONTH END, e, INTERVAL 6 MONTH))::DATE AS d FROM b),
 u AS (SELECT code, d FROM p UNION SELECT code, s FROM b UNION SELECT code, e FROM b),
 n AS (SELECT code, d AS "from", lead(d) OVER (PARTITION BY code ORDER BY d) AS "to" FROM u) SELECT * FROM n WHERE "to" IS NOT NULL"""
)
def request_intervals_6m(t: Tables) -> DataFrame:
    return Q.intervals(bounds(t), "6MS")


@book.add(
    f"""WITH {BOUNDS_SQL}, p AS (SELECT code, e, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS d FROM b)
 SELECT code, year(d)::BIGINT AS year, month(d)::BIGINT AS month FROM p WHERE last_day(d::DATE) <= e"""
)
def request_month_ends(t: Tables) -> DataFrame:
    return Q.month_ends(bounds(t)).select("code", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@book.add(
    f"""WITH {BOUNDS_SQL}, p AS (SELECT code, unnest(generate_series(s, e, INTERVAL 7 DAY))::DATE AS d FROM b), u AS (SELECT code, d FROM p UNION SELECT code, s FROM b UNION SELECT code, e FROM b),
 n AS (SELECT code, d AS "from", lead(d) OVER (PARTITION BY code ORDER BY d) AS "to" FROM u) SELECT * FROM n WHERE "to" IS NOT NULL"""
)
def request_intervals_7d(t: Tables) -> DataFrame:
    return Q.intervals(bounds(t), "7D")


@book.add(
    """WITH w AS (SELECT DISTINCT o_orderpriority AS code, year(o_orderdate)::BIGINT AS year FROM orders), d AS (SELECT DISTINCT o_orderpriority AS code, year(o_orderdate)::BIGINT AS year FROM orders WHERE o_orderkey % 3 = 0 AND year(o_orderdate) <> 1997)
 SELECT code, year FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.code = w.code AND d.year = w.year) OR year = 2001"""
)
def pending_requests(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderpriority").alias("code"), F.year("o_orderdate").cast("long").alias("year"), "o_orderkey")
    done = own.filter((F.col("o_orderkey") % 3 == 0) & (F.col("year") != 1997))
    return Q.pending(own.select("code", "year").distinct(), done, ["code", "year"], 2001)


YEARLY_SQL = """a AS (SELECT o_orderpriority AS code, year(o_orderdate)::BIGINT AS year, avg(o_totalprice) AS v FROM orders WHERE year(o_orderdate) < 2000 GROUP BY ALL),
 c AS (SELECT o.o_orderpriority AS code, year(l.l_shipdate)::BIGINT AS year, avg(l.l_extendedprice) AS v FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE year(l.l_shipdate) > 1996 GROUP BY ALL)"""


def yearly(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.orders.filter(F.year("o_orderdate") < 2000).groupBy(F.col("o_orderpriority").alias("code"), F.year("o_orderdate").cast("long").alias("year")).agg(F.avg("o_totalprice").alias("value"))
    shipped = t.lineitem.filter(F.year("l_shipdate") > 1996).select("l_orderkey", "l_shipdate", "l_extendedprice").join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return a, shipped.groupBy(F.col("o_orderpriority").alias("code"), F.year("l_shipdate").cast("long").alias("year")).agg(F.avg("l_extendedprice").alias("value"))


@book.add(f"WITH {YEARLY_SQL} SELECT coalesce(a.code, c.code) AS code, coalesce(a.year, c.year) AS year, round(coalesce((a.v + c.v) / 2, a.v, c.v), 4) AS value FROM a FULL JOIN c ON a.code = c.code AND a.year = c.year")
def combine_two_sources_coalesce(t: Tables) -> DataFrame:
    return coverage.combine(*yearly(t), ["code", "year"]).withColumn("value", F.round("value", 4))


@book.add(f"WITH {YEARLY_SQL} SELECT code, year FROM a INTERSECT SELECT code, year FROM c")
def common_years(t: Tables) -> DataFrame:
    a, c = yearly(t)
    return a.select("code", "year").intersect(c.select("code", "year"))


@book.add(
    """WITH y AS (SELECT c.c_nationkey AS k, year(o.o_orderdate)::BIGINT AS year, sum(o.o_totalprice) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)
 SELECT k, min(year) AS year_first, max(year) AS year_last, round(arg_min(v, year), 2) AS value_first, round(arg_max(v, year), 2) AS value_last FROM y GROUP BY 1"""
)
def first_last_trajectory(t: Tables) -> DataFrame:
    own = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    return coverage.trajectory(own, ["k"]).select("k", "year_first", "year_last", F.round("value_first", 2).alias("value_first"), F.round("value_last", 2).alias("value_last"))


CUBE_SQL = """f AS (SELECT r_name AS grp, c_acctbal AS x, (c_custkey % 4) / 4.0 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 l AS (SELECT grp, CASE WHEN x >= 7500 THEN 3 WHEN x >= 5000 THEN 2 WHEN x >= 2500 THEN 1 WHEN x >= 0 THEN 0 END AS level, w FROM f),
 cube AS (SELECT r_name AS grp, k::INT AS level, coalesce((SELECT sum(w) FROM l WHERE l.grp = r_name AND l.level = k), 0)::DOUBLE AS weight FROM region CROSS JOIN generate_series(0, 3) AS g(k))"""


def cube(t: Tables) -> DataFrame:
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = t.customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("grp"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 4 / F.lit(4.0)).alias("w"))
    return coverage.occurrence_cube(facts, t.region.select(F.col("r_name").alias("grp")), (0.0, 2500.0, 5000.0, 7500.0), weight=F.col("w"))


@book.add(f"WITH {CUBE_SQL} SELECT * FROM cube")
def level_occurrence_cube(t: Tables) -> DataFrame:
    return cube(t)


@book.add(f"WITH {CUBE_SQL} SELECT grp, level, weight, coalesce(sum(weight) OVER (PARTITION BY level ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS base FROM cube")
def stacked_cube(t: Tables) -> DataFrame:
    return coverage.stacked(cube(t))


@book.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_codes(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@book.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_missing(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@book.add("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_lookup_broadcast(t: Tables) -> DataFrame:
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@book.add("SELECT n_name, code FROM (SELECT n_name, CASE n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' END AS code FROM nation)")
def dictionary_lookup(t: Tables) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for p in ((0, "AF"), (1, "AM"), (2, "AS"), (3, "EU")) for x in p])
    return t.nation.select("n_name", F.try_element_at(pairs, F.col("n_regionkey")).alias("code"))


@book.add(
    """WITH p AS (SELECT p_partkey, p_partkey % 50 AS g, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS n FROM part), s AS (SELECT s_suppkey, s_suppkey % 50 AS g, row_number() OVER (PARTITION BY s_suppkey % 50 ORDER BY s_suppkey) AS n FROM supplier)
 SELECT p_partkey, s_suppkey FROM p JOIN s USING (g, n)"""
)
def zip_positional(t: Tables) -> DataFrame:
    p = features.position_in_group(t.part.withColumn("g", F.col("p_partkey") % 50), ["g"], ["p_partkey"], "n")
    s = features.position_in_group(t.supplier.withColumn("g", F.col("s_suppkey") % 50), ["g"], ["s_suppkey"], "n")
    return p.join(s, ["g", "n"]).select("p_partkey", "s_suppkey")


@book.add("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0) AS total FROM lineitem")
def rowwise_sum(t: Tables) -> DataFrame:
    own = t.lineitem.withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    return own.select("l_orderkey", "l_linenumber", row_sum("q", "l_discount", "l_tax").alias("total"))


@book.add("SELECT l_orderkey, l_linenumber, l_quantity * 1000 / 0.5::DOUBLE AS mw, l_extendedprice / 1000 AS thousand FROM lineitem")
def unit_scale(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1000 / F.lit(0.5)).alias("mw"), (F.col("l_extendedprice") / 1000).alias("thousand"))


@book.add("SELECT l_orderkey, l_linenumber, name, v FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_quantity, l_discount, l_tax))")
def melt_wide(t: Tables) -> DataFrame:
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "v")


@book.add("SELECT event_type, day, hour, round(v, 6) AS v FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, hour(ts)::BIGINT AS hour, avg(value) AS v FROM events GROUP BY ALL)")
def melt_hours(t: Tables) -> DataFrame:
    """Hours to columns and back."""
    wide = t.events.withColumn("h", F.concat((F.hour("ts") + 1).cast("string"), F.lit("h"))).groupBy("event_type", F.to_date("ts").alias("day")).pivot("h", [f"{k}h" for k in range(1, 25)]).agg(F.avg("value"))
    long = readers.melt_hours(wide, ["event_type", "day"], [f"{k}h" for k in range(1, 25)], "v").filter("v is not null")
    return long.select("event_type", "day", F.col("hour").cast("long").alias("hour"), F.round("v", 6).alias("v"))


@book.add("SELECT o_orderpriority AS p, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY 1")
def pivot_long(t: Tables) -> DataFrame:
    wide = t.orders.groupBy(F.col("o_orderpriority").alias("p")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return wide.select("p", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"))


@book.add(r"""WITH m AS (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS h FROM pages), z AS (SELECT page_id, generate_subscripts(h, 1)::BIGINT - 1 AS n, unnest(h) AS link FROM m) SELECT page_id, n, link FROM z""")
def regex_extract_series(t: Tables) -> DataFrame:
    return readers.parallel_lists(t.pages, "html", {"link": 'href="/([^"]*)"'}, ["page_id"], "n").withColumn("n", F.col("n").cast("long"))


@book.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_keypath(t: Tables) -> DataFrame:
    landed = t.events.select("event_id", F.concat(F.lit('{"records":['), F.col("props"), F.lit("]}")).alias("body"))
    return readers.json_path(landed, "body", "k bigint", ["records"], ["event_id"])


@book.add("SELECT user_id, k FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def json_records(t: Tables) -> DataFrame:
    """Records nested under a key path, as feeds land."""
    landed = t.events.select("user_id", F.concat(F.lit('{"data":{"data":['), F.col("props"), F.lit("]}}")).alias("body"))
    return readers.json_path(landed, "body", "k bigint", ["data", "data"], ["user_id"])


@book.add("SELECT l_shipdate, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def group_sum_by_timestamp(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_shipdate").agg(F.round(F.sum("l_quantity"), 2).alias("total"))


@book.add(
    """WITH u AS (SELECT o_orderdate AS ts, o_totalprice AS value, 0 AS s, o_orderkey AS k FROM orders UNION ALL SELECT l_shipdate, l_extendedprice, 1, l_orderkey * 10 + l_linenumber FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s, k) AS r FROM u WHERE value <> 0) SELECT ts, value FROM n WHERE r = 1"""
)
def union_clean_sources(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), F.struct(F.lit(0).alias("s"), F.col("o_orderkey").alias("k")).alias("ordinal"))
    b = t.lineitem.select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"), F.struct(F.lit(1).alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).alias("ordinal"))
    return series.clean(a.unionByName(b), []).select("ts", "value")


@book.add(
    """WITH y AS (SELECT DISTINCT o_orderpriority AS code, year(o_orderdate)::BIGINT AS year FROM orders), a AS (SELECT * FROM (VALUES (1995), (1998), (2000)) v(available))
 SELECT code, year, arg_min(available, (abs(available - year), available))::BIGINT AS available FROM y CROSS JOIN a GROUP BY ALL"""
)
def nearest_year(t: Tables) -> DataFrame:
    years = t.orders.select(F.col("o_orderpriority").alias("code"), F.year("o_orderdate").cast("long").alias("year")).distinct()
    known = years.select("code").distinct().withColumn("available", F.explode(F.array(*[F.lit(y).cast("long") for y in (1995, 1998, 2000)])))
    return features.nearest(years, known, ["code"])


RECORD_SQL = """r AS (SELECT event_id, (event_id % 3)::INT AS is_weekend, (hour(ts) + (event_id % 7 = 0)::INT * 5)::INT AS hour, (event_id % 14)::INT AS month, value AS gdp FROM events)"""


@book.add(f"WITH {RECORD_SQL} SELECT event_id, (is_weekend BETWEEN 0 AND 1 AND hour BETWEEN 0 AND 24 AND month BETWEEN 1 AND 12 AND gdp > 0) AS valid FROM r")
def validation_split(t: Tables) -> DataFrame:
    own = t.events.select("event_id", (F.col("event_id") % 3).cast("int").alias("is_weekend"), (F.hour("ts") + (F.col("event_id") % 7 == 0).cast("int") * 5).alias("hour"), (F.col("event_id") % 14).cast("int").alias("month"), F.col("value").alias("year_gdp_ppp"))
    fields = {k: forecast.RECORD[k] for k in ("is_weekend", "hour", "month", "year_gdp_ppp")}
    good, bad = forecast.validated(own, fields)
    return good.select("event_id", F.lit(True).alias("valid")).union(bad.select("event_id", F.lit(False).alias("valid")))


@book.add("WITH p AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type, hour(ts)) AS prediction FROM events) SELECT event_type, round(avg(abs(prediction - value)), 6) AS mae, count(*)::BIGINT AS n FROM p GROUP BY 1")
def mae_by_group(t: Tables) -> DataFrame:
    means = t.events.groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("prediction"))
    joined = t.events.withColumn("h", F.hour("ts")).join(means, ["event_type", "h"])
    return forecast.mae_by_group(joined, "event_type", "value").withColumn("mae", F.round("mae", 6))


@book.add(
    """WITH w AS (SELECT c_nationkey AS code, c_custkey AS position, c_acctbal / avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS prediction FROM customer),
 y AS (SELECT n_nationkey AS code, year::BIGINT AS year, (n_nationkey + 1) * (year - 2000) / 10.0::DOUBLE AS twh FROM nation CROSS JOIN generate_series(2018, 2042) AS g(year))
 SELECT code, position, year, round(prediction * twh * 1e6 / 8760, 4) AS load_mw FROM w JOIN y USING (code) WHERE year >= 2020 AND year <= 2040 AND (year - 2020) % 5 = 0"""
)
def denormalize_projection(t: Tables) -> DataFrame:
    weather = features.group_mean_normalized(t.customer.select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("position"), "c_acctbal"), ["code"], "c_acctbal", "prediction").withColumn("year", F.lit(2019))
    annual = t.nation.select(F.col("n_nationkey").alias("code"), F.explode(F.sequence(F.lit(2018).cast("long"), F.lit(2042).cast("long"))).alias("year")).withColumn("twh", (F.col("code") + 1) * (F.col("year") - 2000) / F.lit(10.0))
    projected = forecast.project(weather, annual, 2020, 2040)
    out = projected.withColumn("load_mw", F.col("prediction") * forecast.mean_power(F.col("twh")))
    return out.select("code", "position", "year", F.round("load_mw", 4).alias("load_mw"))


@book.add("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'a' WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN 'b' ELSE 'c' END AS rule FROM orders")
def rules_by_year(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.when(y.between(1995, 1996), "a").when(y.between(1997, 1999), "b").otherwise("c").alias("rule"))


@book.add("WITH d AS (SELECT o_custkey, max(o_orderdate)::DATE - min(o_orderdate)::DATE AS days FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN days / 365 >= 20 THEN 3 WHEN days / 365 >= 10 THEN 2 WHEN days / 365 >= 5 THEN 1 ELSE 0 END::INT AS class FROM d")
def coverage_classes(t: Tables) -> DataFrame:
    days = t.orders.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    return days.select("o_custkey", coverage.coverage_class(F.col("days")).alias("class"))


@book.add("WITH v AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, hour(ts)::BIGINT AS version, count(*) FILTER (event_id % 9 = 0)::BIGINT AS rows FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY version DESC) AS r FROM v WHERE rows > 0) SELECT event_type, day, version, rows FROM n WHERE r = 1")
def newest_version(t: Tables) -> DataFrame:
    own = t.events.groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("version")).agg(F.count_if(F.col("event_id") % 9 == 0).alias("rows"))
    keyed = readers.newest_with_rows(own.withColumn("k", F.struct("event_type", "day")), "k", "version", "rows")
    return keyed.drop("k")


@book.add(f"WITH {YEARLY_SQL} SELECT a.code, a.year, round(coalesce((a.v + c.v) / 2, a.v, c.v), 4) AS value FROM a LEFT JOIN c ON a.code = c.code AND a.year = c.year")
def lookup_by_year(t: Tables) -> DataFrame:
    a, c = yearly(t)
    return a.join(c.withColumnRenamed("value", "w"), ["code", "year"], "left").select("code", "year", F.round(either(F.col("value"), F.col("w")), 4).alias("value"))


@book.add("SELECT event_id, (ts + INTERVAL 90 MINUTE) AS shifted, date_trunc('second', ts + INTERVAL 500 MILLISECOND)::TIMESTAMP AS rounded FROM events")
def label_shift(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.hours(F.col("ts"), 1.5).alias("shifted"), T.round_second(F.col("ts")).alias("rounded"))


@book.add("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, 1")
def value_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "event_type")


@book.add("SELECT min(year(o_orderdate))::BIGINT AS lo, max(year(o_orderdate))::BIGINT AS hi, count(DISTINCT year(o_orderdate))::BIGINT AS n FROM orders")
def year_bounds(t: Tables) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    return t.orders.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_distinct(y).alias("n"))


@book.add("SELECT n_name AS code FROM nation UNION SELECT r_name FROM region")
def union_distinct(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("code")).union(t.region.select("r_name")).distinct()


@book.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@book.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def exclude_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@book.add("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id FROM n WHERE r > 1")
def drop_last_row(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("r", F.row_number().over(order)).filter("r > 1").select("user_id", "event_id")


@book.add(
    """WITH q AS (SELECT n_nationkey AS k, substr(n_name, 1, length(n_name) - 1) AS asked FROM nation), p AS (SELECT k, n_name, levenshtein(asked, n_name) AS d FROM q CROSS JOIN nation)
 SELECT k::BIGINT AS k, arg_min(n_name, (d, n_name)) AS name FROM p GROUP BY 1"""
)
def fuzzy_names(t: Tables) -> DataFrame:
    """Misspelt names to the nearest of a dictionary."""
    asked = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.expr("substr(n_name, 1, length(n_name) - 1)").alias("asked"))
    return fuzzy.nearest_names(asked, t.nation.select(F.col("n_name").alias("name"))).select("k", "name")


@book.add(
    """WITH q AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN reverse(c_name) WHEN 1 THEN substr(c_name, 2) || 'x' WHEN 2 THEN substr(c_name, 1, 4) || substr(c_name, 6) ELSE c_name || c_custkey % 1000 END AS asked FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING'),
 k AS (SELECT c_name || CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE '' END AS name FROM customer), p AS (SELECT k, name, levenshtein(asked, name) AS d FROM q JOIN k ON abs(length(asked) - length(name)) <= 2 AND levenshtein(asked, name) <= 2)
 SELECT q.k, arg_min(name, (d, name)) AS name, min(d)::INT AS distance FROM q LEFT JOIN p ON q.k = p.k GROUP BY 1"""
)
def fuzzy_customers(t: Tables) -> DataFrame:
    """Misspelt names of customers to the nearest of all, up to two edits away; some are beyond."""
    k, name = F.col("c_custkey"), F.col("c_name")
    spelt = F.when(k % 4 == 0, F.reverse(name)).when(k % 4 == 1, F.concat(F.substr(name, F.lit(2)), F.lit("x"))).when(k % 4 == 2, F.concat(F.substring(name, 1, 4), F.substr(name, F.lit(6)))).otherwise(F.concat(name, (k % 1000).cast("string")))
    asked = t.customer.filter((k % 3 == 0) | (F.col("c_mktsegment") == "BUILDING")).select(k.alias("k"), spelt.alias("asked"))
    known = t.customer.select(F.concat(name, F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise("")).alias("name"))
    return fuzzy.nearest_names(asked, known).select("k", "name", "distance")


@book.add(
    """WITH d AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 24 AS h FROM orders)
 SELECT o_orderkey, (date_trunc('day', d) + to_hours(h::BIGINT))::TIMESTAMP AS iso, (date_trunc('day', d) + to_hours(h::BIGINT))::TIMESTAMP AS european, (date_trunc('day', d) + to_hours((h % 12)::BIGINT))::TIMESTAMP AS american FROM d"""
)
def time_formats(t: Tables) -> DataFrame:
    day, h = F.col("o_orderdate"), F.col("o_orderkey") % 24
    text = lambda form: F.date_format(day, form)
    iso = F.concat(text("yyyy-MM-dd"), F.lit(" "), F.lpad(h.cast("string"), 2, "0"))
    european = F.concat(text("dd/MM/yyyy"), F.lit(" "), F.lpad(h.cast("string"), 2, "0"), F.lit(":00:00"))
    american = F.concat(text("yyyy dd-MMM"), F.lit(" "), F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit("AM"))
    parsed = [F.to_timestamp(x, f).cast("timestamp_ntz").alias(n) for x, f, n in ((iso, "yyyy-MM-dd HH", "iso"), (european, "dd/MM/yyyy HH:mm:ss", "european"), (american, "yyyy dd-MMM ha", "american"))]
    return t.orders.select("o_orderkey", *parsed)


@book.add("SELECT o_orderkey, CAST(trunc(o_totalprice / 1000) AS BIGINT)::VARCHAR AS label, CAST(trunc(-o_totalprice / 250) AS BIGINT)::VARCHAR AS below FROM orders")
def whole_labels(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", whole_label(F.col("o_totalprice"), 1000).alias("label"), whole_label(-F.col("o_totalprice"), 250).alias("below"))


@book.add("SELECT DISTINCT year, dayofyear(make_date(year, 12, 31))::BIGINT AS days FROM (SELECT year(o_orderdate) - o_custkey % 110 AS year FROM orders)")
def leap_years(t: Tables) -> DataFrame:
    """Years of orders, and of up to 109 years before, with their days."""
    years = t.orders.select((F.year("o_orderdate") - F.col("o_custkey") % 110).alias("year")).distinct()
    return years.select("year", T.days_in_year(F.col("year").cast("int")).cast("long").alias("days"))


@book.add("WITH n AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages) SELECT page_id, host, regexp_extract(host, '([^.]+)[.]', 1) AS first, host LIKE '%.org' AS org, upper(substr(host, 1, 3)) AS head FROM n")
def string_functions(t: Tables) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return t.pages.select("page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+)[.]", 1).alias("first"), host.endswith(".org").alias("org"), F.upper(F.substring(host, 1, 3)).alias("head"))


@book.add("WITH p AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*)::BIGINT AS turns, min(turn - before)::BIGINT AS step, arg_min(role, turn) AS opens FROM p GROUP BY 1")
def group_steps(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("step", F.col("turn") - before).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("step").alias("step"), F.min_by("role", "turn").alias("opens"))
