"""Packing of documents into training sequences by cutting-stock column generation.

A document's ids, with an end id, are cut into chunks of the sequence length and one rest. The histogram of the chunks' lengths, in
classes of `grain` ids, short ones in bundles, is the demand of a cutting-stock problem. Its linear program is solved by column generation: the dual values of
the present patterns price every length, a knapsack program over the capacity finds the pattern of most value, and the simplex step takes
it in until none is worth more than one sequence. The program's pattern counts are rounded down, what remains is packed one sequence at a time,
the widest left and what fills it best, and the
chunks, ranked within their length class, are dealt to the patterns' places.

Only the histogram, of some hundred rows, reaches the driver; only the plan, of at most that many patterns and the rounded
rest, reaches the executors. Ranks are numbered in salted parts, so a length shared by a third of all documents is no single task.

Nulls: a null text is empty and becomes its end id alone. A null doc_id is kept. Repeated rows are packed as often as they come. Ties in
rank go by doc_id, then start. An empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.shared import map_rows, ranked, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The chunks of each document: doc_id, start, length, ids_crc32 and doc_tokens; with_ids: and the ids."""

    def cut(rows: dict[str, list]) -> dict[str, object]:
        from gridloom.llm.bpe import encoder

        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc, ids in zip(rows["doc_id"], encoder(tokenizer).encode([t or "" for t in rows["text"]])):
            data = np.append(ids, np.uint32(end_id)).astype("<u4")
            for start in range(0, len(data), capacity):
                part = data[start : start + capacity]
                for k, v in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(data), part.tolist() if with_ids else None)):
                    out[k].append(v)
        return out

    return map_rows(docs.select("doc_id", "text"), PIECES + (", ids array<long>" if with_ids else ""), cut)


@dataclass
class Plan:
    """Where the chunks of each length class go. For class k, entries first[k]:first[k+1]: from rank `start` on, `per` chunks go to each sequence from `sequence` on."""

    first: np.ndarray
    start: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    sequences: int
    bound: float

    def place(self, klass: np.ndarray, rank: np.ndarray) -> np.ndarray:
        wide = np.int64(1) << np.int64(40)
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * wide + self.start
        at = np.searchsorted(key, klass * wide + rank, side="right") - 1
        return self.sequence[at] + (rank - self.start[at]) // self.per[at]


def solve(width: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2500, gap: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns (counts per class), how often each is used in the linear program, and its value, by column generation.

    width: of each class; demand: its number. It ends when no pattern is worth over 1 + gap sequences, which bounds the value's distance from
    the best by that share. `rounds` bounds the simplex steps; any basis is a valid set of patterns.
    """
    m = len(width)
    fit = capacity // width
    basis = [np.where(np.arange(m) == i, fit, 0) for i in range(m)]
    inverse = np.diag(1.0 / fit)
    used = demand / fit
    order = np.argsort(width, kind="stable")
    w = width[order]
    for _ in range(rounds):
        price = inverse.sum(0)
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        y = price[order]
        upto = np.searchsorted(w, np.arange(capacity + 1), side="right")
        for c in range(int(w[0]), capacity + 1):
            n = upto[c]
            got = value[c - w[:n]] + y[:n]
            k = int(got.argmax())
            value[c], choice[c] = (got[k], k) if got[k] > value[c - 1] else (value[c - 1], -1)
        if value[capacity] <= 1 + gap:
            break
        column, c = np.zeros(m, np.int64), capacity
        while c >= w[0]:
            if choice[c] < 0:
                c -= 1
            else:
                column[order[choice[c]]] += 1
                c -= int(w[choice[c]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        t = ratio[out]
        used = np.maximum(used - t * step, 0)
        used[out] = t
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = column
    return basis, used, float(used.sum())


def plan(width: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Rounds the linear program's solution to whole patterns that hold each class's demand exactly."""
    m = len(width)
    if not m:
        none = np.zeros(0, np.int64)
        return Plan(np.zeros(1, np.int64), none, none, none, 0, 0.0)
    patterns, used, bound = solve(width, demand, capacity)
    left = demand.copy()
    final: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-used, kind="stable"):
        column = patterns[k]
        some = column > 0
        n = int(min(np.floor(used[k] + 1e-6), (left[some] // column[some]).min()))
        if n > 0:
            final.append((column, n))
            left -= column * n
    order = np.argsort(-width, kind="stable").tolist()
    widths, rest = width.tolist(), left.tolist()
    while any(rest):  # the widest that is left, and what fills its sequence best
        own = [i for i in order if rest[i]]
        column = np.zeros(m, np.int64)
        column[own[0]] = 1
        room = capacity - widths[own[0]]
        reach, seen = 1, []  # bit s: a sum of s is reachable
        for i in own:
            for _ in range(min(rest[i] - (i == own[0]), room // widths[i])):
                seen.append((i, reach))
                reach |= reach << widths[i]
            if reach >> room & 1:
                break
        at = (reach & ((1 << room + 1) - 1)).bit_length() - 1
        for i, had in reversed(seen):
            if not had >> at & 1:
                column[i] += 1
                at -= widths[i]
        some = np.flatnonzero(column)
        n = min(rest[i] // int(column[i]) for i in some)
        final.append((column, n))
        for i in some:
            rest[i] -= int(column[i]) * n
    entries: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
    taken, sequence = np.zeros(m, np.int64), 0
    for column, n in final:
        for i in np.flatnonzero(column):
            entries[i].append((int(taken[i]), int(column[i]), sequence))
            taken[i] += int(column[i]) * n
        sequence += n
    flat = np.array([e for own in entries for e in own], np.int64).reshape(-1, 3)
    return Plan(np.concatenate(([0], np.cumsum([len(e) for e in entries]))), flat[:, 0], flat[:, 1], flat[:, 2], sequence, bound)


def bundle(length: int, grain: int) -> int:
    """How many pieces of a short length are planned as one, so that rounding their sum up to the grain adds nothing, or little."""
    if length < 8 * grain:
        return grain // gcd(length, grain)
    return max(1, 32 * grain // (1 << (length.bit_length() - 1)))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, grain: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    grain: what lengths are rounded up to for the plan. Pieces under 32 grains are ranked by their exact length and planned in bundles, in which
    under 8 grains nothing is lost by rounding, and beyond that under grain in 32 of them.
    """
    wide = F.when(F.col("length") < 32 * grain, F.col("length")).otherwise(F.ceil(F.col("length") / F.lit(grain)) * grain).cast("int").alias("class")
    cut = stored(pieces(docs, tokenizer, capacity, end_id).select("*", wide, F.monotonically_increasing_id().alias("piece")), "pieces")
    histogram = sorted((r["class"], r["n"]) for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect())
    classes = np.array([c for c, _ in histogram], np.int64)
    each = np.array([bundle(c, grain) for c, _ in histogram], np.int64)
    count = np.array([n for _, n in histogram], np.int64)
    whole = count // each  # bundles; what is over is planned piece by piece
    planned = np.concatenate([-(-classes * each // grain), -(-classes // grain)])
    widths, kind = np.unique(planned, return_inverse=True)
    before, demand = np.zeros(len(planned), np.int64), np.zeros(len(widths), np.int64)  # before: of the same width, from the entries before
    for i, (k, n) in enumerate(zip(kind.tolist(), np.concatenate([whole, count - whole * each]).tolist())):
        before[i] = demand[k]
        demand[k] += n
    some = np.flatnonzero(demand)
    kind = np.searchsorted(some, kind)
    widths, demand = widths[some], demand[some]
    plans = plan(widths, demand, capacity // grain)
    # salted by the piece, so that the pieces of equal or missing ids are no one task's
    numbered = ranked(cut, ["class"], ["piece"], ["doc_id", "start", "piece"], sum(n for _, n in histogram))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def place(rows: dict[str, list]) -> dict[str, object]:
        klass = np.searchsorted(classes, np.array(rows["class"], np.int64))
        rank = np.array(rows["rank"], np.int64)
        over = rank - whole[klass] * each[klass]
        entry = np.where(over < 0, klass, klass + len(classes))
        nth = np.where(over < 0, rank // each[klass], over)
        return {n: rows[n] for n in names} | {"sequence_id": plans.place(kind[entry], before[entry] + nth), "_rank": rows["rank"], "_class": rows["class"]}

    placed = map_rows(numbered, PIECES + ", sequence_id long, _rank long, _class int", place)
    own = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
    return placed.select(*names, "sequence_id", (F.sum("length").over(own) - F.col("length")).alias("offset"))
