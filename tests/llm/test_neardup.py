import random
import re
from collections import Counter

import numpy as np

from gridloom.llm import neardup


def weights(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jaccard(a, b):
    more = sum((a | b).values())
    return sum((a & b).values()) / more if more else 0.0


def brute(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    own = [weights(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = own[i] == own[j] if own[i] or own[j] else (texts[i] or "") == (texts[j] or "")
            if same or jaccard(own[i], own[j]) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def corpus(prose):
    r = random.Random(2)
    texts = prose(60, 1, 40, 200)
    for t in texts[:25]:
        for k in range(r.choice((1, 2, 5))):
            words = t.split()
            for _ in range(r.choice((1, 1, 2, 4, 8))):
                words[r.randrange(len(words))] = "changed" + str(r.randrange(1000))
            texts.append(" ".join(words))
            if r.random() < 0.4:
                t = texts[-1]  # copies of copies: chains of links
    return texts + texts[3:6] + [texts[7].upper() + "!!", "", "", "one two three", "One, two; three"]


def test_classes_equal_brute_force(docs_of, prose):
    texts = corpus(prose)
    want = brute(texts)
    rows = {r["doc_id"]: r for r in neardup.classes(docs_of([(t, "en") for t in texts])).collect()}
    assert [rows[i]["class_id"] for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(rows[i]["class_size"] == sizes[want[i]] for i in range(len(texts)))


def test_keep_first(docs_of, prose):
    texts = corpus(prose)
    kept = {r["doc_id"] for r in neardup.keep_first(docs_of([(t, "en") for t in texts])).collect()}
    assert kept == set(brute(texts))


def test_signatures_estimate_probability_jaccard():
    a, b = np.arange(1, 101), np.arange(41, 141)
    element = neardup.mix(np.concatenate([a, b]).astype(np.uint64)) >> np.uint64(24)
    weight = np.concatenate([1 + a % 3, 1 + b % 5]).astype(float)
    s = neardup.prob_minhash(element, weight, np.repeat([0, 1], 100), 2, 8192)
    x, y = dict(zip(a, weight[:100])), dict(zip(b, weight[100:]))
    want = sum(1 / sum(max(x.get(k, 0) / x[i], y.get(k, 0) / y[i]) for k in {*x, *y}) for i in set(x) & set(y))
    assert abs((s[0] == s[1]).mean() - want) < 0.02


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["class_size"]))
    assert by[1] == [(1, 2)] * 2 and by[2] == [(2, 3)] and by[3] == [(2, 3)] and by[9] == [(9, 1)]
    assert sorted(n for _, n in by[None]) == [2, 2, 3] and sum(c < 0 for c, _ in by[None]) == 2
    kept = neardup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 1
    assert neardup.classes(no_docs).collect() == [] and neardup.keep_first(no_docs).collect() == []


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 200)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in [*range(100, 160), 200]} == {100}


def template_corpus(prose, n, pairs):
    """n texts that share a long passage, under 0.8 alike, and texts a little over 0.8 alike to the first of them."""
    r = random.Random(5)
    passage = prose(1, 11, 100, 100)[0].rstrip(".")
    texts = [passage + " " + " ".join(f"own{i}x{k}" for k in range(r.choice((14, 15, 18, 25)))) for i in range(n)]
    return texts + [t.rsplit(" ", 12)[0] + "".join(f" other{i}x{k}" for k in range(12)) for i, t in enumerate(texts[:pairs])]


def test_near_copies_among_texts_of_one_template(docs_of, prose, monkeypatch):
    texts = template_corpus(prose, 90, 40)
    want = brute(texts)
    assert len(set(want)) == 90
    for small, block in ((neardup.SMALL, neardup.BLOCK), (2, 7)):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
        rows = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of([(t, "en") for t in texts])).collect()}
        assert [rows[i] for i in range(len(texts))] == want


def test_candidates_hold_every_link(spark):
    r = random.Random(8)
    sets = []
    for _ in range(60):
        base = r.sample(range(300), r.randint(5, 120))
        sets += [base, [v for v in base if r.random() > 0.06] + r.sample(range(300, 400), r.randint(0, 6))]
    pack = lambda v: b"".join((x >> 8).to_bytes(4, "little") for x in v) + bytes(x & 255 for x in v)
    packed = [(i, i % 7, bytearray(pack(sorted(int(neardup.mix(np.array([x], np.uint64))[0] >> np.uint64(24)) for x in set(s))))) for i, s in enumerate(sets)]
    found = {(p["a"], p["b"]) for p in neardup.candidates(spark.createDataFrame(packed, "node long, label long, shingles binary"), 0.8).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if i % 7 != j % 7 and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert len(alike) > 20 and alike <= found


def test_keep_first_of_shared_and_missing_ids(spark, prose):
    """Of two texts of one id, one of them a copy of an earlier row, the other stays; copies without an id go."""
    p = prose(4, 41, 40, 60)
    rows = [(1, p[0]), (5, p[0]), (5, p[1]), (None, p[1]), (None, p[2]), (None, p[2]), (7, p[3]), (7, p[3])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, _row string").repartition(3)
    kept = neardup.keep_first(docs)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, p[0]), (5, p[1]), (0, p[2]), (7, p[3])]) and kept.columns == docs.columns


def test_recall_by_similarity(spark, small):
    """Every pair of the table that is 0.8 alike or more is in one class; none under it is linked but through others."""
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    own = [weights(t) for t in texts]
    bands = {0.5: [], 0.7: [], 0.8: [], 0.9: []}
    for i in range(len(texts)):
        for j in range(i):
            if (s := jaccard(own[i], own[j])) >= 0.5:
                bands[max(b for b in bands if b <= s)].append(got[i] == got[j])
    print("pairs in one class, of all, by similarity", {b: (sum(v), len(v)) for b, v in bands.items()})
    assert all(bands[0.8]) and all(bands[0.9]) and [got[i] for i in range(len(texts))] == brute(texts)


def test_counters_take_a_row_a_slice(spark):
    sets = [sorted(random.Random(k).sample(range(1 << 40), 2000)) for k in range(40)] + [[7, 7 + (1 << 20), 1 << 39]]
    packed = [bytes(np.array([x >> 8 for x in own], "<u4").tobytes() + np.array([x & 255 for x in own], np.uint8).tobytes()) for own in sets]
    members = spark.createDataFrame([(p,) for p in packed], "shingles binary").repartition(4)
    assert neardup.counted(members).count() <= 4 * neardup.COUNTERS // neardup.SLICE  # of 80,003 shingles
    truth = np.bincount([x % neardup.COUNTERS for own in sets for x in own], minlength=neardup.COUNTERS)
    assert (neardup._counters(members) == truth).all()
