"""Toxicity scores: a logistic classifier with counterfactual regularisation.

In each labelled text that mentions a group, the identity terms are swapped for another term of their kind, and the training penalises the
squared change of the logit beside the loss, so that the mention itself moves no score and neutral mentions are not taken for toxic.
Features: whether a word, or a word's first 4, 5 or 6 bytes, is in the text, hashed to 2^20 places; FTRL with L1 keeps those that tell.

Nulls and empty texts get the score of the bias. Labels are read only of rows whose crc32(doc_id) mod 5 is not 0; at most SAMPLE rows of
each label are used. Labels that are neither 0 nor 1 are not read; of an id's several labels the greatest counts. Without labels every
score is 0.5. Repeated rows get equal scores; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.linear import WIDTH, Ftrl, Linear, Sample, distinct_features, sample, score, sigmoid, weights_of
from gridloom.llm.shared import Words, map_rows, mix

SAMPLE = 4000
EPOCHS = 5
PENALTY = 1.0
#: Identity terms by kind; a term is swapped for the next of its kind.
TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("she", "he"), ("her", "his"), ("mother", "father"), ("sister", "brother"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("old", "young"), ("deaf", "hearing"), ("blind", "sighted"), ("disabled", "abled"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"), ("noir", "blanc"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarz", "weiß"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"), ("negro", "blanco"),
)
SWAP = {a: kind[(k + 1) % len(kind)] for kind in TERMS for k, a in enumerate(kind)}
_TERM = re.compile(r"\b(" + "|".join(map(re.escape, sorted(SWAP, key=len, reverse=True))) + r")\b", re.IGNORECASE)


def swapped(text: str | None) -> str | None:
    """The text with its identity terms swapped; None if it has none."""
    if not text or not _TERM.search(text):
        return None
    return _TERM.sub(lambda m: SWAP[m[0].lower()], text)


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    words = Words(texts)
    hashes, docs = [mix(words.hash)], [words.doc]
    length = words.end - words.start
    for n in (4, 5, 6):
        long = np.flatnonzero(length > n)
        part = object.__new__(Words)
        part.buf, part.start, part.end = words.buf, words.start[long], words.start[long] + n
        hashes.append(mix(part._hashes() + np.uint64(n)))
        docs.append(words.doc[long])
    return [(i, np.ones(len(i))) for i, _ in distinct_features(np.concatenate(hashes), np.concatenate(docs), len(texts))]


def fit(rows, epochs: int = EPOCHS, penalty: float = PENALTY) -> Linear:
    """rows: (y, indices, values, twin), read once an epoch; twin: the (indices, values) of the swapped text, or None without identity terms."""
    learner = Ftrl(1 << WIDTH, alpha=0.1, l1=4.0, l2=1.0)
    weight = weights_of(rows)
    for _ in range(epochs):
        for y, index, value, twin in rows:
            at, v = np.append(index, 1 << WIDTH), np.append(value, 1.0)
            w = learner.weights(at)
            w[-1] = learner.model_bias()
            logit = float(w @ v)
            learner.update(at, (sigmoid(logit) - y) * weight[y] * v)
            if twin is not None and penalty:
                other, values = twin
                both = np.union1d(index, other)
                x = np.zeros(len(both))
                x[np.searchsorted(both, index)] += value
                x[np.searchsorted(both, other)] -= values
                moved = both[x != 0]
                x = x[x != 0]
                if len(moved):
                    gap = float(learner.weights(moved) @ x)
                    learner.update(moved, 2 * penalty * gap * x)
    return learner.model()


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5)."""

    def pair(cols: dict[str, list]) -> dict[str, object]:
        texts = [t or "" for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "y": cols["y"], "text": texts, "twin": [swapped(t) for t in texts]}

    rows = Sample(map_rows(sample(docs, labels, "toxic", SAMPLE).select("doc_id", "text", "y"), "doc_id long, y int, text string, twin string", pair), features)
    model = fit(rows)
    rows.close()
    return score(docs, model, features, 0.5)
