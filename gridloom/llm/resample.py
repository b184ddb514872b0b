"""Importance resampling towards a target's distribution, over hashed word n-grams.

The words of a batch are interned in an open-addressed table by their bytes, runs of two and three words by the slots of their words, which is
the same as by their bytes. A slot holds its key's bucket and its number of occurrences: the counting pass adds the numbers up by bucket, the
scoring pass gathers the buckets' gains by the slots of a document's occurrences. A document's score is its weight, the sum of gains, plus a
Gumbel draw of its id, so that the highest scores are a sample without replacement, by weight.

Both passes read all rows. Counts of a task leave it as one row a bucket. The highest scores are numbered by ranges of the score, so no task
holds all rows; rows of equal score and id are counted first and numbered in salts.

Nulls: a null text has no words. A null doc_id draws nothing: its score and rank are null, and it is not among the N documents. Very long texts
are counted whole, in runs of words. Rows of one id and score are ranked in any order among each other. Without documents there are no rows; an
empty target has no counts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.interning import PAD, Table, crc_of_joined, packed
from gridloom.llm.shared import _WORD, _slices, keyed, map_rows, ranked, stored

#: Words handled at once.
RUN = 200_000
#: Ranges of the score by which the highest are numbered, and the share of rows that is looked at for each drawn one.
RANGES = 256
MARGIN = 1.2


class Runs:
    """The words of some texts: runs of ASCII letters, digits and bytes from 128 on, A-Z in lower case. first: index of each text's first word, and the end."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        self.buf = np.frombuffer(b"\n".join(parts) + bytes(PAD), np.uint8)
        edge = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        step = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[self.buf])).astype(np.int8)))
        self.start, self.end = step[::2], step[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, edge)))
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))

    def interned(self, most: int) -> Iterator[tuple[int, np.ndarray, Table, np.ndarray]]:
        """(n, index of the first word of each occurrence, table, CRC-32 of each slot) for the runs of 1 to most words, RUN first words at a time."""
        for lo in range(0, len(self.start), RUN):
            hi = min(lo + RUN, len(self.start))
            last = min(hi + most - 1, len(self.start))
            start, length = self.start[lo:last], self.end[lo:last] - self.start[lo:last]
            words = Table(self.buf, start, length)
            own = [self.buf[start[i] : start[i] + length[i]].tobytes() for i in words.first]
            alone = np.fromiter((zlib.crc32(w) for w in own), np.uint32, len(own))
            spaced = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in own), np.uint32, len(own))
            width = np.fromiter((len(w) + 1 for w in own), np.int64, len(own))
            if hi < last:
                words.count = np.bincount(words.slot[: hi - lo], minlength=len(own))
            table, crc = words, alone
            for n in range(1, most + 1):
                at = lo + np.flatnonzero(self.left[lo:hi] >= n)
                if not len(at):
                    break
                if n == 1:
                    yield 1, at, table, crc
                    continue
                table = Table(*packed(*(words.slot[at - lo + j] for j in range(n))))
                words_of = at[table.first] - lo
                crc = alone[words.slot[words_of]]
                for j in range(1, n):
                    w = words.slot[words_of + j]
                    crc = crc_of_joined(crc, spaced[w], width[w])
                yield n, at, table, crc


def bucket_counts(docs: DataFrame, buckets: int, most: int) -> DataFrame:
    """bucket, n: occurrences of runs of 1 to `most` words of all texts, by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _slices([len(t or "") for t in texts]):
                for _, _, table, crc in Runs(texts[lo:hi]).interned(most):
                    np.add.at(total, crc % buckets, table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """A bucket's gain: a thousand times the log ratio of its smoothed shares of the target and of the documents, rounded down."""
    all_raw, all_target = sum(raw.values()), sum(target.values())
    ratio = ((target.get(b, 0) + 1) * (all_raw + buckets) / ((raw.get(b, 0) + 1) * (all_target + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """_row, doc_id, n_words, n_features, weight of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(rows: dict[str, list]) -> dict[str, object]:
        words = Runs(rows["text"])
        first = words.first
        each = np.zeros(len(words.start) + 1, np.int64)  # by first word: the gains of the runs that begin there
        for _, at, table, crc in words.interned(most):
            by_slot = held.value[crc % len(held.value)]
            each[at] += by_slot[table.slot[: len(at)]]
        sums = np.concatenate(([0], np.cumsum(each)))
        n = np.diff(first)
        features = sum(np.maximum(n - k, 0) for k in range(most))
        return {"_row": rows["_row"], "doc_id": rows["doc_id"], "n_words": n, "n_features": features, "weight": sums[first[1:]] - sums[first[:-1]]}

    return map_rows(docs.select("_row", "doc_id", "text"), "_row string, doc_id long, n_words long, n_features long, weight long", run)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for documents that are not drawn.

    buckets bounds what the driver holds and broadcasts. percent of the documents of at least least_words words are drawn.
    """
    counted = [{r["bucket"]: r["n"] for r in bucket_counts(t, buckets, most).collect()} for t in (docs, target)]
    own = keyed(docs.select("doc_id", "text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(own, gains(*counted, buckets), most).withColumn("score", (F.col("weight") + draw).cast("long"))
    return drawn(stored(weighed, "weighed"), F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, able: F.Column, percent: int) -> DataFrame:
    """scored(_row, doc_id, score) with rank: 1, 2, ... of the floor(percent * N / 100) highest scores of the N able rows, ties to the smaller id."""
    able = F.coalesce(able & F.col("score").isNotNull(), F.lit(False))
    near = min(1.0, MARGIN * percent / 100)
    # the estimate is off by at most N / accuracy rows, far less than the margin
    cuts = [1 - near + near * i / RANGES for i in range(RANGES)]
    own = scored.filter(able).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", cuts, 20_000).alias("cuts")).first()
    take = percent * own["n"] // 100
    if not take:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    edges = F.array(*[F.lit(c) for c in sorted(set(own["cuts"]))])
    high = able & (F.col("score") >= own["cuts"][0])
    top = scored.filter(high)
    keys = top.groupBy("score", "doc_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.size(F.filter(edges, lambda e: e <= F.col("score"))))
    sizes = keys.groupBy("_range").agg(F.sum("_n").alias("_size"))  # a row a range: RANGES at most
    above = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    before = Window.partitionBy("_range").orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    base = keys.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(above), "_range")
    base = base.select("score", "doc_id", (F.col("_above") + F.col("_before")).alias("_base"))
    place = ranked(top, ["score", "doc_id"], ["_row"], ["_row"], own["n"], "_place").join(base, ["score", "doc_id"])
    rank = F.col("_base") + F.col("_place") + 1
    given = place.withColumn("rank", F.when(rank <= take, rank)).select(*scored.columns, "rank")
    return given.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))
