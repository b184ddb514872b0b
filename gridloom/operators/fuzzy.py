"""Names looked up in a dictionary of any size with up to two letters wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import bounded


def _shorter(text: Column) -> Column:
    """The text with each of its letters left out once."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1)))


def neighbourhood(text: Column, distance: int) -> Column:
    """The text and all that is left of it without up to `distance` letters; n * n / 2 strings of n letters for a distance of 2."""
    found = latest = F.array(text)
    for _ in range(distance):
        latest = F.array_distinct(F.flatten(F.transform(latest, _shorter)))
        found = F.concat(found, latest)
    return F.array_distinct(found)


def nearest_names(asked: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """asked(k, asked) with the name of known(name) that is the fewest edits away, and its distance; of equal ones the first by name; null beyond `distance`.

    Texts that are so many edits apart are equal without as many letters each, so both sides' neighbourhoods are joined by the hashes of their
    strings, and only pairs that meet are compared. Names of a length that no question can have are left out first. A name has hundreds of such
    strings, which the planner's estimates don't tell of, so that join is never a broadcast. Rows of one k are one question each; a null
    text has no name.
    """
    # dealt by number, as adaptive execution would put a million bytes of names, which become hundreds of millions, into one task
    tasks = 3 * known.sparkSession.sparkContext.defaultParallelism
    names = known.select("name").filter(F.col("name").isNotNull()).distinct()
    left = asked.select("asked").filter(F.col("asked").isNotNull()).distinct()
    lengths = left.select(F.length("asked").alias("asked")).distinct().select(F.explode(F.sequence(F.col("asked") - distance, F.col("asked") + distance)).alias("_length")).distinct()
    names = names.join(bounded(lengths), F.length("name") == F.col("_length"), "left_semi").repartition(tasks, "name")
    parts = lambda c: F.explode(F.transform(neighbourhood(F.col(c), distance), lambda p: F.xxhash64(p))).alias("_part")
    met = left.repartition(tasks, "asked").select("asked", parts("asked")).join(names.select("name", parts("name")).hint("merge"), "_part")
    # a pair meets in several strings; each time it is compared, which costs less than to tell the pairs apart
    edits = F.levenshtein("asked", "name", distance)
    best = met.withColumn("distance", edits).filter(F.col("distance") >= 0).groupBy("asked").agg(F.min(F.struct("distance", "name")).alias("_b")).select("asked", "_b.name", "_b.distance")
    return asked.join(best, "asked", "left").select(*asked.columns, "name", "distance")
