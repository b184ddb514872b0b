import random
import re
from collections import Counter

import pytest

from gridloom.llm import decontaminate


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, threshold=0.8):
    """The best similarity of every window that shares a shingle in its place with the item, by all windows."""
    out = {}
    for d, text in docs.items():
        w = words_of(text)
        for i, item in items.items():
            v = words_of(item)
            if not v or len(w) < min(5, len(v)):
                continue
            want, n = shingles(v), min(len(v), len(w))
            for s in range(len(w) - n + 1):
                own = shingles(w[s : s + n])
                j = sum((own & want).values()) / sum((own | want).values())
                if j >= threshold:
                    out[d, i] = max(out.get((d, i), 0), j)
    return out


def setup(spark, prose, docs_of):
    r = random.Random(4)
    items = dict(enumerate(prose(12, 9, 12, 60)))
    texts = prose(40, 10, 30, 150)
    for k in range(30):
        v = items[k % 12].split()
        if k % 3 == 1:
            v[-1] = "other"
        if k % 5 == 2:
            v[0] = "first"
        if k % 7 == 3:
            v[len(v) // 2] = "middle"  # five shingles less: under the threshold if the item is short
        w = texts[k].split()
        at = r.choice((0, len(w), r.randrange(len(w))))
        texts[k] = " ".join([*w[:at], *[x.upper() if k % 2 else x for x in v], *w[at:]])
    items |= {90: "two Shortwords", 91: "lone-word-of-four, words"}
    texts[33] += " two shortwords."
    texts[34] = "Two, shortwords! " + texts[34]
    texts += ["two shortwords", "two longer shortwords", "of four words", "xx lone word of four words"]
    benchmark = spark.createDataFrame([*items.items(), (98, None), (99, "")], "item_id long, text string")
    return dict(enumerate(texts)), items, docs_of([(t, "en") for t in texts]), benchmark


def test_leaks_equal_brute_force(spark, prose, docs_of, monkeypatch):
    texts, items, docs, benchmark = setup(spark, prose, docs_of)
    want = brute(texts, items)
    assert len(want) > 20
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.clean(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == texts.keys() - {d for d, _ in want} and kept.columns == docs.columns
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    large = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, benchmark).collect()}
    assert large == got


def test_blocks_meet_every_pair_within_the_radius(spark):
    r = random.Random(8)
    pairs = []
    for k in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        pairs.append((k, *[x - (1 << 64) if x >> 63 else x for x in (a, b)]))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "k long, a long, b long")
    met = df.select("k", F.arrays_overlap(decontaminate.block_values(F.col("a"), False), decontaminate.block_values(F.col("b"), True)).alias("met"))
    assert met.filter("not met").count() == 0


def test_weighted_similarity(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 1, 2, 3], [1, 2, 2, 4])], "a array<long>, b array<long>")
    assert df.select(decontaminate.weighted_jaccard(F.col("a"), F.col("b"))).first()[0] == 2 / 6


def test_odd_rows(spark, odd_docs, no_docs):
    text = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 1)
    benchmark = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "item_id long, text string")
    got = decontaminate.leaks(odd_docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (1, None)} and len(got) == 2
    assert decontaminate.clean(odd_docs, benchmark).count() == odd_docs.count() - 2
    assert decontaminate.leaks(no_docs, benchmark).collect() == []
    assert decontaminate.leaks(odd_docs, benchmark.limit(0)).collect() == []
    assert decontaminate.clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


@pytest.mark.parametrize("ids", [[None] * 6, [7] * 6, [1, 1, 2, 2, None, None]])
def test_rows_that_share_or_lack_an_id(spark, prose, ids):
    item = prose(1, 21, 20, 20)[0]
    other = prose(1, 22, 20, 20)[0]
    texts = [*prose(4, 23, 30, 60), prose(1, 24, 30, 30)[0] + " " + item, item]
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in zip(ids, order)], "doc_id long, text string, lang string, _row string, _metadata string").coalesce(1)
        benchmark = spark.createDataFrame([(None, other), (None, item), (3, item)], "item_id long, text string")
        want = {(ids[order.index(t)], b) for t in texts[4:] for b in (None, 3)}
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == want
        kept = decontaminate.clean(docs, benchmark)
        assert sorted(r["text"] for r in kept.collect()) == sorted(texts[:4]) and kept.columns == docs.columns


def test_recall_by_similarity(spark, prose):
    """Of windows edited to be 0.8 or more alike to an item, the share that is found, by band; an unedited one always is."""
    r = random.Random(14)
    items = prose(400, 31, 15, 59)
    texts, alike = [], []
    for k, item in enumerate(items):
        words = item.rstrip(".").split()
        for _ in range(k % 3):
            words[r.choice((0, len(words) - 1, 1, len(words) - 2, r.randrange(len(words))))] = f"edit{k}"
        a, b = shingles(words), shingles(words_of(item))
        alike.append(sum((a & b).values()) / sum((a | b).values()))
        texts.append(f"before{k} it " + " ".join(words) + f" and{k} after")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    share = lambda lo, hi: [k in found for k, s in enumerate(alike) if lo <= s < hi]
    figures = {band: (sum(share(*band)), len(share(*band))) for band in ((0.8, 0.85), (0.85, 0.9), (0.9, 1), (1, 2))}
    print("recall by similarity", figures)
    assert all(share(1, 2)) and not any(share(0, 0.8)) and sum(share(0.8, 1)) >= 0.98 * len(share(0.8, 1))


def test_no_python_in_the_plan(spark, odd_docs, capsys):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").filter("item_id > 0")
    plan = decontaminate.leaks(odd_docs.select("doc_id", "text"), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
