"""Retrieval from answers made of events: over requests of orders, with planted failures, and of two feeds as they are sent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import time as T
from gridloom.plans import pipelines
from gridloom.plans.base import Book, Tables
from gridloom.session import shared_folder
from gridloom.sources import landings, retrieval
from gridloom.sources import requests as Q

book = Book()


def answer(request: dict) -> str:
    """What the source answers: nothing on every eleventh day, an error on every seventeenth, and after some attempts on the others."""
    number = request["number"]
    if number % 11 == 0 or request["landed"] is None:
        raise retrieval.NoData
    request["tries"] = request.get("tries", 0) + 1
    if number % 17 == 5 or request["tries"] <= number % 4:
        raise ConnectionError("no answer")
    return request["landed"]


def parse(df: DataFrame) -> DataFrame:
    return df.select("code", "day", F.explode(F.from_json("body", "array<struct<id:long,value:double>>")).alias("e")).select("code", "day", "e.*")


@book.add(
    """WITH c AS (SELECT DISTINCT 'C' || (o_custkey % 6) AS code FROM orders), e AS (SELECT 'C' || (user_id % 7) AS code, ts::DATE AS day, value FROM events),
 r AS (SELECT code, unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY))::DATE AS day FROM c),
 n AS (SELECT *, datediff('day', DATE '2000-01-01', day) + ascii(substr(code, 2)) AS number FROM r),
 g AS (SELECT code, day, count(*) AS events, sum(value) AS total FROM e GROUP BY 1, 2),
 o AS (SELECT n.code, n.day, CASE WHEN number % 11 = 0 OR events IS NULL THEN 'none' WHEN number % 17 = 5 THEN 'failed' ELSE 'data' END AS outcome, CASE WHEN number % 11 = 0 OR events IS NULL THEN 1 WHEN number % 17 = 5 THEN 5 ELSE 1 + number % 4 END AS attempts, events, total FROM n LEFT JOIN g ON g.code = n.code AND g.day = n.day)
 SELECT code, outcome, count(*) AS requests, sum(attempts)::BIGINT AS attempts, coalesce(sum(CASE WHEN outcome = 'data' THEN events END), 0)::BIGINT AS events, coalesce(round(sum(CASE WHEN outcome = 'data' THEN total END), 4), 0) AS total FROM o GROUP BY 1, 2"""
)
def retrieved_requests(t: Tables) -> DataFrame:
    """By code and outcome: requests, attempts, and what was written and read back."""
    events = t.events.select(F.concat(F.lit("C"), F.col("user_id") % 7).alias("code"), F.to_date("ts").alias("day"), F.struct(F.col("event_id").alias("id"), "value").alias("e"))
    span = events.agg(F.min("day").alias("start"), F.max("day").alias("end"))
    codes = t.orders.select(F.concat(F.lit("C"), F.col("o_custkey") % 6).alias("code")).distinct()
    days = Q.days(codes.join(F.broadcast(span)))  # span is one row
    landed = events.groupBy("code", "day").agg(F.to_json(F.collect_list("e")).alias("landed"))
    number = F.datediff("day", F.lit("2000-01-01").cast("date")) + F.ascii(F.substring("code", 2, 1))
    requests = days.join(landed, ["code", "day"], "left").withColumn("number", number)
    path = f"{shared_folder(t._spark).rstrip('/')}/retrieved-{uuid.uuid4().hex}"
    outcomes = retrieval.run(requests, answer, parse, path, ["code", "day"], ["code", "day"], retries=5, delay=0.0)
    written = t._spark.read.parquet(f"{path}/data").groupBy("code", "day").agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))
    total = [F.coalesce(F.sum("_n"), F.lit(0)).alias("events"), F.coalesce(F.round(F.sum("_v"), 4), F.lit(0.0)).alias("total")]
    return outcomes.join(written, ["code", "day"], "left").groupBy("code", "outcome").agg(F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts"), *total)


@book.add(
    """SELECT event_type AS code, (date_trunc('hour', ts) + INTERVAL 6 HOUR)::TIMESTAMP AS ts, round(sum(value) / 1000, 9) AS value FROM events GROUP BY 1, 2 HAVING sum(value) <> 0"""
)
def feed_of_days(t: Tables) -> DataFrame:
    """Answers of days with a field an hour, made from events, to clean instants and MW."""
    named = t.events.select(F.col("event_type").alias("code"), F.to_date("ts").cast("string").alias("Date"), F.date_format("ts", "HH").alias("h"), "value")
    hours = named.groupBy("code", "Date").pivot("h", [f"{h:02d}" for h in range(24)]).agg(F.sum("value"))
    item = F.struct("Date", F.struct(*[F.col(f"{h:02d}").alias(f"Hour{h + 1:02d}") for h in range(24)]).alias("Values"))
    answers = hours.select("code", F.to_json(F.struct(F.array(item).alias("Items"))).alias("text"))
    return pipelines.retrieve(landings.colombia(answers), "xm").withColumn("value", F.round("value", 9))


@book.add(
    """WITH h AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS b, sum(value) AS value FROM events GROUP BY 1, 2),
 n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY b) AS n FROM h)
 SELECT event_type AS code, (TIMESTAMP '2024-01-01 00:00:00' + n * INTERVAL 30 MINUTE)::TIMESTAMP AS ts, round(value, 6) AS value FROM n WHERE value <> 0"""
)
def feed_of_a_year(t: Tables) -> DataFrame:
    """Answers that are lists of half hours without times, made from events, to clean instants and MW."""
    halves = t.events.groupBy(F.col("event_type").alias("code"), T.bucket(F.col("ts"), 30).alias("b")).agg(F.sum("value").alias("ND"))
    records = F.transform(F.array_sort(F.collect_list(F.struct("b", "ND"))), lambda r: F.struct(r["ND"].alias("ND")))
    lists = halves.groupBy("code").agg(records.alias("r"))
    answers = lists.select("code", F.lit(2024).alias("year"), F.to_json(F.struct(F.struct(F.col("r").alias("records")).alias("result"))).alias("text"))
    return pipelines.retrieve(landings.great_britain(answers), "neso").withColumn("value", F.round("value", 6))
