"""Runs of repeated words in texts, by maximal pairs.

A run of period q and length n is the maximal pair of its first place and the place q words on, with n - q words in common: the words before
the two differ, or there is none, and so do the words after. Maximal pairs are read off the tree of intervals of equal common prefixes in the
suffix array, from its leaves upwards: where two intervals meet at a common prefix of L words, each place of the smaller one is compared with
its neighbours among the places of the larger one. A pair whose distance is at most L / (exponent - 1) is a run, and nothing needs extending.

Two places of a word sequence of L words that lie within a third of L of each other belong to one arithmetic progression, so within reach only
the next place on either side can be the partner, of all the lists of places by the word before; the lists are held as one, by place, with the word before
of each. A pair whose distance is a multiple of the period covers the same words as the run; the least distance is kept.

The suffix array of all texts of a batch is made by doubling, with ranks that tell texts apart, and only places that share four words with
another place of their text go further.

Nulls: a null text has no words; a null doc_id is never altered. Very long texts are read whole. Repeated rows each get their result. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.shared import map_rows

#: Places in one piece of a list; a piece of twice as many is cut.
PIECE = 1000


class Places:
    """An ordered list of places in pieces, to which places are added anywhere."""

    def __init__(self, place: int) -> None:
        self.pieces, self.last, self.size = [[place]], [place], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def near(self, place: int) -> tuple[int, int]:
        """The next places before and after, -1 where there is none."""
        k = bisect_left(self.last, place)
        if k == len(self.pieces):
            return self.last[-1], -1
        piece = self.pieces[k]
        i = bisect_left(piece, place)
        return piece[i - 1] if i else self.last[k - 1] if k else -1, piece[i]

    def add(self, place: int) -> None:
        k = min(bisect_left(self.last, place), len(self.pieces) - 1)
        piece = self.pieces[k]
        insort(piece, place)
        if len(piece) > 2 * PIECE:
            self.pieces[k : k + 1] = [piece[:PIECE], piece[PIECE:]]
            self.last[k : k + 1] = [piece[PIECE - 1], piece[-1]]
        else:
            self.last[k] = piece[-1]
        self.size += 1


def _suffixes(word: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common) of the places that share `least` or more words with another of their text, in suffix order; common[i]: the number of
    words that places i - 1 and i share."""
    n = len(word)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank]
    size = np.diff(np.append(np.flatnonzero(new), n))
    live = order[np.repeat(size, size) > 1]
    kept, width = live, 1
    while len(live):
        after = live + width
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        own = rank[live]
        group = np.concatenate(([True], np.diff(own) != 0))
        new = group | np.concatenate(([True], np.diff(second) != 0))
        index = np.arange(len(live))
        rank = rank.copy()
        rank[live] = own + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(size, size) > 1]
        width *= 2
        if width <= least:
            kept = live
    if not len(kept):
        return kept, kept
    places = kept[np.argsort(rank[kept], kind="stable")]
    a, b = places[:-1], places[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        level = levels[k]
        common += np.where(inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]), 1 << k, 0)
    return places, np.concatenate(([0], common))


def find(word: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period), by start and period, of all runs of at least `least` words and `exponent` periods.

    word: ids of the words of some texts, one text after another; first: where each begins, and the end. exponent is 4 or more.
    """
    if exponent < 4:
        raise ValueError("the neighbours of a place suffice from an exponent of 4 on")
    if not len(word):
        return []
    shortest = min(max(least, exponent * q) - q for q in range(1, least + 1))
    places, common = _suffixes(word, first, min(shortest, 4))
    cut = common < shortest
    if not len(places) or cut.all():
        return []
    # groups without two places near enough for their longest common prefix hold no run
    group = np.cumsum(cut) - 1
    begins = np.flatnonzero(cut)
    longest = np.maximum.reduceat(np.where(cut, 0, common), begins)
    by_place = np.lexsort((places, group))
    gap = np.concatenate(([1 << 60], np.diff(places[by_place])))
    gap[begins] = 1 << 60
    wanted = np.minimum.reduceat(gap, begins) * (exponent - 1) <= longest
    before = word[np.maximum(np.arange(len(word)) - 1, 0)].copy()
    before[first[:-1][first[:-1] < len(word)]] = -1
    ends = np.append(begins[1:], len(places))
    found: dict[tuple[int, int], int] = {}

    def meet(a: Places, b: Places, shared: int) -> Places:
        small, large = (a, b) if a.size < b.size else (b, a)
        reach = shared // (exponent - 1)
        for place in small:
            for other in large.near(place):
                gap = abs(other - place)
                if other >= 0 and gap <= reach and shared + gap >= least and before[place] != before[other]:
                    stretch = min(place, other), max(place, other) + shared
                    found[stretch] = min(gap, found.get(stretch, gap))
        for place in small:
            large.add(place)
        return large

    for g in np.flatnonzero(wanted):
        own, depth = places[begins[g] : ends[g]].tolist(), common[begins[g] : ends[g]].tolist()
        nodes, shared = [Places(own[0])], []
        for place, d in zip(own[1:], depth[1:]):
            while shared and shared[-1] >= d:
                top = nodes.pop()
                nodes.append(meet(nodes.pop(), top, shared.pop()))
            nodes.append(Places(place))
            shared.append(d)
        while shared:
            top = nodes.pop()
            nodes.append(meet(nodes.pop(), top, shared.pop()))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word of a text becomes, for a tenth of all ids; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def word_runs(docs: DataFrame, least: int = 6, exponent: int = 4, alter: bool = False) -> DataFrame:
    """One row per document: n_runs; start, length, period and exponent_milli of its longest run; runs_sha256 of all runs and collapsed_sha256
    of the text without the repeats. Words are what white space (blank, tab to carriage return) parts. alter: the words of altered() are taken."""

    def run(rows: dict[str, list]) -> dict[str, object]:
        number: dict[bytes, int] = {}
        ticket = count()
        texts, ids, first = [], [], [0]
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            words = (text or "").encode("utf-8", "replace").split()
            own = np.fromiter(map(number.setdefault, words, ticket), np.int64, len(words))
            moved = altered(doc_id, len(words)) if alter else None
            if moved is not None:
                words, own = [words[i] for i in moved.tolist()], own[moved]
            texts.append(words)
            ids.append(own)
            first.append(first[-1] + len(words))
        edge = np.array(first)
        runs = find(np.concatenate([np.zeros(0, np.int64), *ids]), edge, least, exponent)
        owner = np.searchsorted(edge, [r[0] for r in runs], side="right") - 1
        own_runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (s, n, q) in zip(owner.tolist(), runs):
            own_runs[k].append((s - first[k], n, q))
        out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for words, own in zip(texts, own_runs):
            best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            if own:
                keep = np.ones(len(words), bool)
                for s, n, q in own:
                    keep[s + q : s + n] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            row = (len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
            for column, value in zip(out.values(), row):
                column.append(value)
        return {"doc_id": rows["doc_id"], **out}

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_rows(docs.select("doc_id", "text"), schema, run)
