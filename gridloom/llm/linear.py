"""Hashed sparse features of texts, logistic regression by follow-the-regularised-leader, and the bounded labelled sample that it is fitted on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import Words, discard, fold, hash_sample, map_rows, mix, stored

#: Bits of a feature's index.
WIDTH = 20
Features = Callable[[list], list]


def distinct_features(hashes: np.ndarray, doc: np.ndarray, docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, counts) of each text's hashed features."""
    key = (doc.astype(np.uint64) << np.uint64(WIDTH)) | (hashes >> np.uint64(64 - WIDTH))
    key, count = np.unique(key, return_counts=True)
    edge = np.searchsorted(key >> np.uint64(WIDTH), np.arange(docs + 1, dtype=np.uint64))
    index = (key & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
    return [(index[a:b], count[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` documents of each label value 0 and 1, the first by a hash of doc_id, of those whose fold is not 0: doc_id, text, y.

    The ids are at most 2 x rows, so they are broadcast, and no text is shuffled.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = hash_sample(known, "doc_id", "y", rows).select("doc_id", "y")
    # of several texts of an id the least, so that every run learns from the same
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        """A sparse dot product."""
        return float(self.weights[index] @ value) + self.bias


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Ftrl:
    """FTRL-Proximal: weights from the sum of gradients, with a rate for each feature, and L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, gradient: np.ndarray) -> None:
        w = self.weights(at)
        more = self.n[at] + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more

    def model_bias(self) -> float:
        """The last weight, which has no L1."""
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha + self.l2))

    def model(self) -> Linear:
        return Linear(self.weights(slice(None))[:-1].astype(np.float32), self.model_bias())


def score(docs: DataFrame, model: Linear, features: Features, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, object]:
        found = [sigmoid(held.value.logit(i, v)) for i, v in features(rows["text"])]
        return {"doc_id": rows["doc_id"], "score": found, "predicted": [int(s >= threshold) for s in found]}

    out = map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", run)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


class Sample:
    """The labelled sample's features, in a table, read row by row as often as a fit asks: the driver holds one partition's rows at a time.

    Iteration gives (y, indices, values, twin), in order of a hash of the id; twin: the (indices, values) of the row's second text, or None."""

    def __init__(self, rows: DataFrame, features: Features) -> None:
        """rows: doc_id, text, y and, if rows have a second text, twin."""
        second = "twin" in rows.columns

        def run(cols: dict[str, list]) -> dict[str, object]:
            n = len(cols["text"])
            found = features([*cols["text"], *(cols["twin"] if second else [])])
            packed = [(i.astype("<u4").tobytes(), v.astype("<f4").tobytes()) for i, v in found]
            other = [(p if t is not None else (None, None)) for p, t in zip(packed[n:], cols["twin"])] if second else [(None, None)] * n
            hashes = mix(np.array(cols["doc_id"], np.int64).view(np.uint64)).view(np.int64).tolist()
            return {"h": hashes, "id": cols["doc_id"], "y": cols["y"], "index": [p[0] for p in packed[:n]], "value": [p[1] for p in packed[:n]], "index2": [o[0] for o in other], "value2": [o[1] for o in other]}

        schema = "h long, id long, y int, index binary, value binary, index2 binary, value2 binary"
        self.table = stored(map_rows(rows.select("doc_id", "text", "y", *["twin"] * second), schema, run), "sample")
        number = {r["y"]: r["count"] for r in self.table.groupBy("y").count().collect()}
        self.size, self.ones = sum(number.values()), number.get(1, 0)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        read = lambda i, v: (np.frombuffer(i, "<u4").astype(np.int32), np.frombuffer(v, "<f4"))
        for r in self.table.orderBy("h", "id").toLocalIterator():
            yield r["y"], *read(r["index"], r["value"]), read(r["index2"], r["value2"]) if r["index2"] is not None else None

    def close(self) -> None:
        discard(self.table)


def weights_of(rows) -> list[float]:
    """Weights of the labels 0 and 1 with which both weigh alike in sum. rows: a Sample, or a list."""
    ones = rows.ones if isinstance(rows, Sample) else sum(r[0] for r in rows)
    return [len(rows) / (2 * max(1, len(rows) - ones)), len(rows) / (2 * max(1, ones))]


class Tokens(Words):
    """Words as runs of bytes other than white space, in their case, for features that tell shapes apart."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        self.buf = buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        edge = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        word = buf > 32
        step = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        self.start, self.end = step[::2], step[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, edge))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.hash = self._hashes()

    def shapes(self) -> "Tokens":
        """The same tokens with each letter, each capital and each digit alike, and repeats of a sign once."""
        table = np.arange(256, dtype=np.uint8)
        table[97:123] = table[128:] = 97
        table[65:91] = 65
        table[48:58] = 48
        shape = table[self.buf]
        word = self.buf > 32
        kept = np.concatenate(([True], shape[1:] != shape[:-1])) | ~word
        out = object.__new__(Tokens)
        place = np.cumsum(kept) - kept
        out.buf = shape[kept]
        out.start, out.first, out.doc = place[self.start], self.first, self.doc
        out.end = place[self.end - 1] + kept[self.end - 1]
        out.hash = out._hashes()
        return out
