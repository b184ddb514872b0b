import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SCHEMA, rows_of

from gridloom.llm import resample as R
from gridloom.llm.interning import PAD, Table, crc_of_joined, xxh64
from gridloom.llm.queries import op11_resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, target, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of each row."""

    def features(text):
        w = WORD.findall((text or "").translate(UPPER))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    own = [(d, *features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, (d, n, fs) in enumerate(own):
        weight = sum(gain[bucket(f)] for f in fs)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                able.append((-score, d, i))
        out.append([d, len(fs), weight, score, None])
    for r, (_, _, i) in enumerate(sorted(able)[: 5 * len(able) // 100]):
        out[i][4] = r + 1
    return sorted(map(tuple, out), key=repr)


def test_hash_table_and_sums():
    r = random.Random(1)
    keys = [bytes(r.choices(b"ab \xc3", k=r.choice([0, 1, 3, 4, 5, 7, 8, 9, 31, 32, 33, 63, 64, 65, 511, 512, 600]))) for _ in range(2000)]
    buf = np.frombuffer(b"".join(keys) + bytes(PAD), np.uint8)
    length = np.array([len(k) for k in keys])
    start = np.cumsum(length) - length
    assert xxh64(buf, start, length).tolist() == [xxhash.xxh64_intdigest(k) for k in keys]
    table = Table(buf, start, length)
    assert [keys[table.first[s]] for s in table.slot] == keys and len(table.first) == len(set(keys))
    assert {keys[f]: int(c) for f, c in zip(table.first, table.count)} == Counter(keys)
    sums = np.array([zlib.crc32(k) for k in keys], np.uint32)
    assert crc_of_joined(sums[:-1], sums[1:], length[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(keys, keys[1:])]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    from gridloom.llm import interning

    monkeypatch.setattr(interning, "xxh64", lambda buf, start, length: np.full(len(start), 7, np.uint64))
    keys = [b"one", b"two", b"one", b"onE", b"", b"0123456789", b"0123456788", b"0123456789", b""]
    buf = np.frombuffer(b"".join(keys) + bytes(PAD), np.uint8)
    length = np.array([len(k) for k in keys])
    table = Table(buf, np.cumsum(length) - length, length)
    assert [keys[table.first[s]] for s in table.slot] == keys and len(table.first) == 6


def test_query_is_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = op11_resample(spark, small)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target)


def test_runs_of_words_are_cut_anywhere(spark, monkeypatch, prose):
    texts = [*prose(3), None, "", "Ärger ÄRGER straße ⅷ 12ab", "z" * 2000 + " end", "a b", *prose(2, 5, 200, 400)]
    whole = [(n, at.tolist(), crc[table.slot[: len(at)]].tolist()) for n, at, table, crc in R.Runs(texts).interned(3)]
    monkeypatch.setattr(R, "RUN", 7)
    cut = list(R.Runs(texts).interned(3))
    for n in (1, 2, 3):
        parts = [(a, c) for k, at, table, crc in cut if k == n for a, c in zip(at.tolist(), crc[table.slot[: len(at)]].tolist())]
        assert parts == [p for k, at, crc in whole if k == n for p in zip(at, crc)]
    for n, at, table, _ in cut:
        assert table.count.sum() == len(at)


def test_odd_rows(spark, odd_docs, no_docs, prose):
    target = spark.createDataFrame([(prose(1)[0],), (None,)], "text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, R.resample(odd_docs, target).collect()), key=repr) == brute(rows, [r.text for r in target.collect()])
    assert R.resample(no_docs, target).count() == 0
    assert R.resample(odd_docs, target.limit(0)).count() == len(rows)


@pytest.mark.parametrize("copies", [1, 400])
def test_ranks_with_ties_and_one_hot_id(spark, copies):
    r = random.Random(3)
    rows = [(f"r{i}", i, r.randint(0, 30)) for i in range(600)] + [(f"h{i}", 1000, 31) for i in range(copies)] + [("n", None, None), ("m", 5, 99)]
    scored = spark.createDataFrame([(a, d, s, a != "m") for a, d, s in rows], "_row string, doc_id long, score long, able boolean")
    got = R.drawn(scored, R.F.col("able"), 20).collect()
    order = sorted([(-s, d) for a, d, s in rows if s is not None and a != "m"])
    want = order[: len(order) * 20 // 100]
    assert len(got) == len(rows)
    drawn = sorted((g["rank"], -g["score"], g["doc_id"]) for g in got if g["rank"])
    assert [d[0] for d in drawn] == list(range(1, len(want) + 1)) and [d[1:] for d in drawn] == want


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(450_000))
    docs = spark.createDataFrame(rows_of([(1, text, "en"), (2, "a b c", "en")]), SCHEMA)
    got = {r.doc_id: tuple(r)[1:3] for r in R.resample(docs, docs.select("text").filter("doc_id = 2")).collect()}
    want = {r[0]: r[1:3] for r in brute([(1, text), (2, "a b c")], ["a b c"])}
    assert got == want
