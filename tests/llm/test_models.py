import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, linear, quality, toxicity
from gridloom.llm.shared import Words


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")


def test_language_of_held_out_rows(tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs, langid.fit(docs)).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    own = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(own) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.005
    assert langid.keep_known(docs, langid.fit(docs)).count() >= 0.995 * len(truth)


def test_kneser_ney_sums_to_one():
    """For each seen context, the probabilities of all characters, seen or not, make one."""
    words = ["abra", "abba", "bar", "cab", "abracadabra", "a"]
    model = langid.Model.of({"x": langid.train(words, np.array([3, 1, 4, 1, 5, 9]))})
    model.letters = 6  # a, b, c, d, r and the space
    for prefix in ("", "a", "ab", "abr", "c"):
        chances = [probability(model, (prefix + c).strip(), len(prefix)) for c in "abcdr "]
        assert abs(sum(chances) - 1) < 1e-5, (prefix, chances)


def probability(model, word, at):
    """Of the character at a place of a word (its length: of the space after)."""
    code = f" {word} "[: at + 2]
    p = 1 / model.letters
    keys = dict(zip(model.keys.tolist(), model.probability[:, 0]))
    heads = dict(zip(model.heads.tolist(), model.rest[:, 0]))
    _, grams, orders, contexts = langid._grams([word])
    for n in range(1, orders[at] + 1):
        head = int(langid.mix(np.array([contexts[n - 1, at] if n > 1 else 0], np.uint64) + np.uint64(n))[0])
        p = keys.get(int(grams[n, at]), 0.0) + heads.get(head, 1.0) * p
    assert len(code) == at + 2
    return p


class PlainKneserNey:
    """The model from its definition: plain counts, sets of left neighbours, one dictionary for each order."""

    def __init__(self, words, counts, order=5):
        self.order, self.count, self.discount = order, {n: {} for n in range(1, order + 1)}, {}
        seen = {n: {} for n in range(1, order + 1)}
        for word, times in zip(words, counts):
            text = f" {word} "
            for end in range(2, len(text) + 1):
                for n in range(1, min(order, end) + 1):
                    gram = text[end - n : end]
                    seen[n].setdefault(gram, []).append((text[end - n - 1] if end - n > 0 else None, times))
        for n, grams in seen.items():
            for gram, places in grams.items():
                left = {a for a, _ in places if a is not None}
                self.count[n][gram] = sum(t for _, t in places) if n == order else len(left) + sum(t for a, t in places if a is None)
            values = list(self.count[n].values())
            once, twice = values.count(1), values.count(2)
            self.discount[n] = min(once / (once + 2 * twice) if once and twice else 0.5, min(values, default=0.5))

    def chance(self, before, char, letters):
        p = 1 / letters
        for n in range(1, min(self.order, len(before) + 1) + 1):
            context = before[len(before) - n + 1 :]
            own = {g: c for g, c in self.count[n].items() if g[:-1] == context}
            if own:
                total = sum(own.values())
                p = max(own.get(context + char, 0) - self.discount[n], 0) / total + self.discount[n] * len(own) / total * p
        return p

    def bits(self, word, letters):
        text = f" {word} "
        return -sum(np.log2(self.chance(text[:k], text[k], letters)) for k in range(1, len(text)))


def test_models_equal_plain_kneser_ney(tables):
    docs, _ = tables
    words = Words([r["text"] for r in docs.limit(12).collect()])
    own = [words.buf[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]
    kinds = sorted(set(own))[:300]
    counts = [own.count(w) for w in kinds]
    for some, times in ((["abra", "abba", "bar", "cab", "abracadabra", "a"], [3, 1, 4, 1, 5, 9]), (kinds, counts)):
        plain, model = PlainKneserNey(some, times), langid.Model.of({"x": langid.train(some, np.array(times))})
        asked = [*some[:60], "unheard", "ab", "zzz", "q"]
        bits, size = model.bits(asked)
        assert size.tolist() == [len(w) + 1 for w in asked]
        assert np.allclose(bits[:, 0], [plain.bits(w, model.letters) for w in asked], rtol=1e-4)


FOREIGN = ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita", "Все люди рождаются свободными и равными в своем достоинстве и правах", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι", "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw"]


def garbled(r):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(60))


def test_rejection_of_foreign_and_garbled_texts(spark, tables):
    """Limits come from texts that trained no model; texts of the learned languages pass but for the stated rate, others don't, nor do mixed ones."""
    docs, _ = tables
    model = langid.fit(docs)
    r = random.Random(4)
    own = [x["text"] for x in docs.filter(F.length("text") > 300).limit(5).collect()]
    odd = [*FOREIGN, *(garbled(r) for _ in range(6)), "".join(r.choices("ABCDEFGHIJabcdefghij0123456789+/", k=900))]
    mixed = [t[:300] + " " + garbled(r) + " " + FOREIGN[1] for t in own]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *mixed, *own])], "doc_id long, text string")
    got = {x["doc_id"]: x["rejected"] for x in langid.identify(rows, model).collect()}
    bad = len(odd) + len(mixed)
    assert all(got[i] for i in range(bad)) and not any(got[i] for i in range(bad, len(got)))
    assert {x["doc_id"] for x in langid.keep_known(rows, model).collect()} == set(range(bad, len(got)))


def test_limits_keep_to_the_stated_rate():
    r = np.random.default_rng(3)
    draw = lambda n: np.exp(r.normal(0.7, 0.1, n))
    for n in (30, 1000, 20_000):
        limit = langid.limits(np.zeros(n, int), draw(n), 2)
        assert (draw(200_000) > limit[0]).mean() < 4 * langid.FALSE_REJECTION and limit[1] == limit[0]
    assert np.isinf(langid.limits(np.zeros(0, int), np.zeros(0), 2)).all()


def test_no_row_both_trains_and_calibrates(tables, monkeypatch):
    docs, _ = tables
    monkeypatch.setattr(langid, "SAMPLE", 50)
    rows = langid.sample(docs.union(docs)).collect()
    by = {}
    for x in rows:
        by.setdefault(x["lang"], []).append(x["trains"])
    assert all(len(v) == 50 and sum(v) == 25 for v in by.values()) and len({x["text"] for x in rows}) > 190


def test_columns_of_any_type_pass(spark):
    docs = spark.sql("select 1L as doc_id, 'some words' as text, named_struct('a-b', 1, 'c', array(timestamp'2024-01-01 00:00:00')) as s, map('k', 1.5) as m, 2L as n_chars")
    from gridloom.llm import secrets

    for out in (secrets.redact(docs), langid.keep_known(docs, langid.Model.of({"x": langid.train(["some", "words"], np.array([1, 1]))}))):
        assert out.schema.simpleString() == docs.schema.simpleString() and [r.asDict(True) for r in out.collect()] == [r.asDict(True) for r in docs.collect()]


def test_scorer_equals_a_plain_sum():
    model = langid.Model.of({"x": langid.train(["abra", "abba", "bar"], np.array([3, 1, 4])), "y": langid.train(["ein", "eine", "rein"], np.array([1, 1, 1]))})
    text = "Abra rein, zzz ABBA bar"
    entropy = langid.Scorer(model).entropies([text, "", None])
    words = ["abra", "rein", "zzz", "abba", "bar"]
    want = sum(-np.log2(max(probability(model, w, k), 1e-12)) for w in words for k in range(len(w) + 1)) / sum(len(w) + 1 for w in words)
    assert abs(entropy[0, 0] - want) < 1e-4 and np.isinf(entropy[1:]).all()


def test_odd_texts_have_no_language(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4, 9))
    assert all(r["lang_pred"] in model.languages for r in rows if r["doc_id"] in (1, 5, 6, 10))
    assert langid.fit(no_docs) is None and {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.keep_known(odd_docs, None).count() == 0 and langid.identify(no_docs, model).collect() == []
    assert langid.keep_known(odd_docs, model).columns == odd_docs.columns


@pytest.mark.parametrize("operator, label, threshold", [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_held_out_labels(tables, operator, label, threshold):
    docs, labels = tables
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    own = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    above = [a > b for a, x in own for b, y in own if x == 1 and y == 0]
    assert np.mean(above) > 0.9 and np.mean([(s >= threshold) == y for s, y in own]) > 0.85


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_odd_rows_have_scores(odd_docs, no_docs, labels, operator):
    rows = operator(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3)}
    assert len(empty) == 1
    assert operator(no_docs, labels).collect() == []
    assert {r["score"] for r in operator(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_counterfactual_penalty_frees_neutral_mentions():
    """Where a group is named in most toxic texts, the penalty lowers what the name alone does to a score."""
    r = np.random.default_rng(0)
    fill = [f"word{k}" for k in range(60)]

    def text(*more):
        return " ".join([*r.choice(fill, 8), *more])

    toxic = [text("idiot", "muslim") for _ in range(150)] + [text("idiot", "man") for _ in range(20)]
    clean = [text("man") for _ in range(150)] + [text("woman") for _ in range(150)] + [text("muslim") for _ in range(5)]
    texts = toxic + clean
    order = r.permutation(len(texts))
    found = toxicity.features(texts)
    twin = toxicity.features([toxicity.swapped(t) or "" for t in texts])
    rows = [(int(k < len(toxic)), *found[k], twin[k] if toxicity.swapped(texts[k]) else None) for k in order]
    gap = {}
    for penalty in (0.0, 2.0):
        model = toxicity.fit(rows, epochs=10, penalty=penalty)
        a, b = toxicity.features(["the muslim walks", "the christian walks"])
        gap[penalty] = abs(model.logit(*a) - model.logit(*b))
        bad, good = (linear.sigmoid(model.logit(*x)) for x in toxicity.features(["you idiot man", "the man walks"]))
        assert bad > good
    assert gap[2.0] < 0.5 * gap[0.0]


def test_swapped():
    assert toxicity.swapped("A Woman and men") == "A man and women" and toxicity.swapped("nothing") is None and toxicity.swapped(None) is None


def test_words_equal_a_regex():
    import re

    texts = ["Hello, WORLD x_y 12ab\n\né È日本 a'b", "", None, "...", "z"]
    words = Words(texts)
    own = [[words.buf[words.start[k] : words.end[k]].tobytes().decode() for k in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
    assert own == [re.findall(r"[0-9a-z\u0080-￿]+", (t or "").lower()) for t in texts]
    same = Words(["world", "WORLD hello"])
    assert same.hash[0] == same.hash[1] == words.hash[1] and same.hash[2] == words.hash[0]


def test_foreign_scripts_are_rejected_and_numbers_are_not(tables, docs_of):
    docs, _ = tables
    model = langid.fit(docs)
    own = docs.filter("lang = 'en' and n_chars > 400").first()["text"][:60]
    rows = [("это совсем другой язык, которого модель не знает", None), (own + " 4284896609045836 25.102.19.31 +1 (208) 555-1177 123456789", None), ("1234 5678", None)]
    got = [r["rejected"] for r in langid.identify(docs_of(rows), model).orderBy("doc_id").collect()]
    assert got == [True, False, True]


def test_ftrl_equals_plain_steps():
    """The learner against the update written out for one weight at a time."""
    r = np.random.default_rng(2)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.4, 0.7
    learner = linear.Ftrl(6, alpha, beta, l1, l2)
    z, n = [0.0] * 7, [0.0] * 7

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(60):
        at = np.sort(r.choice(7, 3, replace=False))
        gradient = r.normal(0, 2, 3)
        learner.update(at, gradient)
        for i, g in zip(at.tolist(), gradient.tolist()):
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i], n[i] = z[i] + g - sigma * weight(i), n[i] + g * g
    assert np.allclose(learner.weights(slice(None)), [weight(i) for i in range(7)])


def test_toxicity_features_equal_plain_ones():
    texts = ["Woman and Womanly, WOMAN!", "", None, "und das Mädchen 42 x"]
    found = toxicity.features(texts)
    one = lambda word: set(toxicity.features([word])[0][0].tolist())
    for text, (index, value) in zip(texts, found):
        words = (text or "").lower().replace(",", "").replace("!", "").split()
        plain = {("w", w) for w in words} | {(n, w.encode()[:n]) for w in words for n in (4, 5, 6) if len(w.encode()) > n}
        assert len(index) == len(plain) and (value == 1).all()
        assert set(index.tolist()) == set().union(*map(one, words), set())


def test_quality_features_equal_plain_ones():
    import re
    from collections import Counter

    text = "The 12 cats, the 3 CATS sat!! on the mat"
    tokens = text.split()
    shape = lambda w: re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", w))))
    shapes = [shape(w) for w in tokens]
    want = Counter()
    for kind, (of, n) in enumerate(((tokens, 1), (tokens, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        want.update((kind, tuple(of[i : i + n])) for i in range(len(of) - n + 1))
    index, value = quality.features([text])[0]
    assert len(index) == len(want) and np.allclose(sorted(value), sorted(np.sqrt(c / len(tokens)) for c in want.values()))
    assert quality.features([None])[0][0].size == 0


def test_counterfactuals_close_the_gap(tables):
    """On labelled rows of the tables that no model was fitted on: swapping identity terms moves the logit less with the penalty than without."""
    docs, labels = tables
    rows = docs.join(labels, "doc_id").filter("toxic is not null").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    train, rest = [r for r in rows if not held(r["doc_id"])], [r for r in rows if held(r["doc_id"])]
    twins = [toxicity.features([t])[0] if (t := toxicity.swapped(r["text"])) else None for r in train]
    own = [(r["toxic"], *f, t) for r, f, t in zip(train, toxicity.features([r["text"] for r in train]), twins)]
    pairs = [(r["text"], t) for r in rest if (t := toxicity.swapped(r["text"]))]
    assert sum(t is not None for t in twins) > 20 and len(pairs) > 5
    gap, wrong = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(own, penalty=penalty)
        logits = [[model.logit(*toxicity.features([t])[0]) for t in p] for p in pairs]
        gap[penalty] = np.mean([abs(a - b) for a, b in logits])
        clean = [r["text"] for r in rest if r["toxic"] == 0 and toxicity.swapped(r["text"])]
        wrong[penalty] = np.mean([model.logit(*toxicity.features([t])[0]) >= 0 for t in clean])
    assert gap[toxicity.PENALTY] <= gap[0.0] and wrong[toxicity.PENALTY] <= wrong[0.0] and gap[toxicity.PENALTY] < 0.2


def test_samples_are_read_in_one_order(spark, prose):
    """Features by row from a table, as from a list; of several texts of an id the least counts."""
    texts = prose(40)
    docs = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    chosen = linear.sample(docs, labels, "quality", 100)
    least = {i: min(texts[i::30]) for i in range(30)}
    assert {r["doc_id"]: r["text"] for r in chosen.collect()} == {i: t for i, t in least.items() if not held(i)}
    twin = F.when(F.col("doc_id") < 9, F.lit("another text"))
    rows = linear.Sample(chosen.withColumn("twin", twin), quality.features)
    first, again = list(rows), list(rows)
    assert len(first) == len(rows) == sum(not held(i) for i in range(30)) and rows.ones == sum(r[0] for r in first)
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(first, again))
    known = {(i % 2, *f[0].tolist()) for i, t in least.items() for f in quality.features([t])}
    assert all((r[0], *r[1].tolist()) in known for r in first) and sum(r[3] is not None for r in first) == sum(not held(i) for i in range(9))
    rows.close()
