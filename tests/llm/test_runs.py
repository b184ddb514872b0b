import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SCHEMA, rows_of

from gridloom.llm.queries import op12_runs
from gridloom.llm.runs import Places, find, word_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w, least=6, exponent=4):
    """(start, length, period) of all runs, by comparing each word with the word q on, for each q."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, exponent * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def digest(doc_id, text, alter=True):
    w = WORD.findall(text or "")
    n = len(w)
    if alter and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    for seed in range(1500):
        r = random.Random(seed)
        docs = []
        for _ in range(r.randint(1, 4)):
            w, size = [], r.choice([0, 5, 20, 60])
            while len(w) < size:
                if r.random() < 0.5:
                    w += [r.randint(0, 3) for _ in range(r.randint(1, 5))]
                else:
                    w += ([r.randint(0, 2) for _ in range(r.randint(1, 4))] * r.randint(2, 8))[: -1 if r.random() < 0.5 else None]
            docs.append(w)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(int)
        want = sorted((s + int(f), n, q) for d, f in zip(docs, first) for s, n, q in brute(d))
        assert find(np.array(sum(docs, []), np.int64), first) == want


@pytest.mark.parametrize("exponent", [4, 5, 7])
def test_other_exponents(exponent):
    r = random.Random(exponent)
    for _ in range(200):
        w = sum(([r.randint(0, 2) for _ in range(r.randint(1, 3))] * r.randint(1, 9) for _ in range(5)), [])
        assert find(np.array(w, np.int64), np.array([0, len(w)]), 3, exponent) == brute(w, 3, exponent)
    with pytest.raises(ValueError):
        find(np.zeros(9, np.int64), np.array([0, 9]), 6, 3)


def test_places():
    r = random.Random(1)
    own, held = Places(50_000), [50_000]
    for p in r.sample(range(50_000), 8000):
        before, after = own.near(p)
        assert before == max((h for h in held if h < p), default=-1) if len(held) < 300 else True
        assert after == min((h for h in held if h > p), default=-1) if len(held) < 300 else True
        own.add(p)
        held.append(p)
    assert list(own) == sorted(held) and own.size == len(held)


def test_long_sequences_take_no_quadratic_time():
    n = 200_000
    for w in (np.zeros(n, np.int64), np.arange(n) % 7, np.arange(n) % 30_000):
        began = time.time()
        assert len(find(w, np.array([0, n]))) == 1
        assert time.time() - began < 30


def test_query_is_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op12_runs(spark, small)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(digest(*r) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    small = [r for r in rows if len(r[1] or "") < 10_000]
    want = sorted((digest(*r) for r in small), key=repr)
    got = [tuple(r) for r in word_runs(odd_docs, alter=True).collect()]
    assert sorted((g for g in got if g[0] != 5), key=repr) == want and len(got) == len(rows)
    assert [g[1:5] for g in got if g[0] == 5] == [(1, 1, 9000, 3)]
    assert word_runs(no_docs).count() == 0


def test_white_space_and_repeats(spark):
    texts = ["a\tb a\nb\x0ba b\x0c\x0da b", "a\xa0b " * 6, " ".join(["ab"] * 6), "x " * 5, "one two three " * 4 + "one two", "x x x x x x y y y y y y x x x x x x", "\x1c \x1c \x1c\x1c"]
    docs = spark.createDataFrame(rows_of([(i, t, "en") for i, t in enumerate(texts * 2)]), SCHEMA)
    got = sorted(map(tuple, word_runs(docs).collect()))
    assert got == sorted(digest(i, t, alter=False) for i, t in enumerate(texts * 2))
