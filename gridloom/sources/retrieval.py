"""Retrieval by request: a scan that asks for each request again until it answers, and a run over many requests that can be taken up where it stopped.

A request is a row. It is asked for within a task; each request's outcome is a row too, so one that fails, or has no data, spoils no other.
`run` goes batch by batch: a batch's rows replace their partitions, then its outcomes enter the manifest. What the manifest holds isn't
asked for again, but for the years that are still open. A run that dies between the two steps writes the same partitions again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.session import lineage_cut
from gridloom.sources import sinks

#: Gets a request as a dict, returns the answer's text; raises NoData if the source has none, and one of RETRIED if it may answer later.
Fetch = Callable[[dict], str]
RETRIED = (ConnectionError, TimeoutError)
OUTCOME = "outcome string, attempts int, error string, body string"


class NoData(Exception):
    """The source answers that it has nothing for the request."""


def ask(fetch: Fetch, request: dict, retries: int = 5, delay: float = 5.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None, str | None]:
    """(outcome, attempts, error, body): 'data', 'none', or 'failed' after `retries` attempts or at once if asking again can't help.

    The pause doubles from `delay` to `longest` seconds."""
    for attempt in range(1, retries + 1):
        try:
            return "data", attempt, None, fetch(request)
        except NoData:
            return "none", attempt, None, None
        except RETRIED as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(min(longest, delay * 2 ** (attempt - 1)))
        except Exception as e:
            return "failed", attempt, f"{type(e).__name__}: {e}", None
    return "failed", retries, error, None


def fetched(requests: DataFrame, fetch: Fetch, retries: int = 5, delay: float = 5.0, tasks: int | None = None) -> DataFrame:
    """requests with outcome, attempts, error and body, a row each. tasks: over how many tasks they are dealt, as one waits for an answer at a time."""
    names = requests.columns
    dealt = requests.repartition(tasks) if tasks else requests
    given = StructType.fromJson(requests.schema.jsonValue())
    schema = StructType([*given.fields, *StructType.fromDDL(OUTCOME).fields])

    def run(batches):
        for pdf in batches:
            found = [ask(fetch, dict(zip(names, row)), retries, delay) for row in pdf.itertuples(index=False, name=None)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["outcome", "attempts", "error", "body"]).astype({"attempts": "int32"})], axis=1)

    return dealt.mapInPandas(run, schema)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The outcomes of all runs into the path; None before the first."""
    try:
        return spark.read.parquet(f"{path}/_manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def pending(spark: SparkSession, requests: DataFrame, path: str, keys: Sequence[str], still_open: Column | None = None) -> DataFrame:
    """Requests without an answer in the manifest ('data' or 'none'), and those that are still open whatever it holds."""
    held = manifest(spark, path)
    if held is None:
        return requests
    answered = held.filter(F.col("outcome") != "failed").select(*keys).distinct()
    left = requests.join(answered, list(keys), "left_anti")
    if still_open is None:
        return left
    return left.unionByName(requests.filter(still_open).join(answered, list(keys), "left_semi"))


def run(requests: DataFrame, fetch: Fetch, parse: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], part: Sequence[str], still_open: Column | None = None, batches: int = 1, retries: int = 5, delay: float = 5.0) -> DataFrame:
    """Asks for the pending requests and writes what they hold to path/data; the outcomes of this run, a row a request, are returned.

    keys tell requests apart; part, some of the keys, are the partitions of the written table: all requests of a partition are in one batch,
    and an answer replaces its partition whole. So where a request is pending, the answered ones of its partition are asked for again.
    parse: rows of requests and body to rows with the part columns. Failed requests are in the manifest, and are asked for in the next run.
    """
    spark = requests.sparkSession
    asked = pending(spark, requests, path, keys, still_open).select(*part).distinct()
    todo = lineage_cut(requests.join(asked, list(part), "left_semi").withColumn("_batch", F.pmod(F.xxhash64(*part), F.lit(batches))))
    outcomes = []
    for b in range(batches):
        own = lineage_cut(fetched(todo.filter(F.col("_batch") == b).drop("_batch"), fetch, retries, delay, spark.sparkContext.defaultParallelism))
        # a partition with a failed request keeps what it had: half of an answer would not be told from a whole one
        broken = own.filter("outcome = 'failed'").select(*part).distinct()
        whole = own.filter("outcome = 'data'").join(broken, list(part), "left_anti")
        sinks.write(parse(whole), f"{path}/data", part)
        entries = own.drop("body").join(broken.withColumn("_broken", F.lit(True)), list(part), "left")
        entries = entries.withColumn("outcome", F.when(F.col("_broken") & (F.col("outcome") == "data"), "failed").otherwise(F.col("outcome"))).drop("_broken")
        entries.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
        outcomes.append(own.drop("body"))
    out = outcomes[0]
    for more in outcomes[1:]:
        out = out.unionByName(more)
    return out
