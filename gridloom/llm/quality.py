"""Quality scores: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features: the runs of one and two tokens as written, and of one to three token shapes, hashed to 2^20 places; a feature's value is the root
of its share of the text's features of its kind. A score is a sparse dot product through the logistic function.

Nulls and empty texts have no feature and get the score of the bias. Labels are read only of rows whose crc32(doc_id) mod 5 is not 0; at
most SAMPLE rows of each label are used. Labels that are neither 0 nor 1 are not read; of an id's several labels the greatest counts. Without
labels every score is 0.5. Repeated rows get equal scores; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.linear import WIDTH, Ftrl, Linear, Sample, Tokens, distinct_features, sample, score, sigmoid, weights_of
from gridloom.llm.shared import mix, ngrams

#: Labelled rows of each value that the model is fitted on at most.
SAMPLE = 4000
EPOCHS = 4


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    tokens = Tokens(texts)
    shapes = tokens.shapes()
    hashes, doc, kind = [], [], []
    for k, (of, n) in enumerate(((tokens, 1), (tokens, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        h, d = ngrams(of, n)
        hashes.append(mix(h + np.uint64(k)))
        doc.append(d)
    total = np.maximum(np.diff(tokens.first), 1)
    return [(i, np.sqrt(c / t)) for (i, c), t in zip(distinct_features(np.concatenate(hashes), np.concatenate(doc), len(texts)), total)]


def fit(rows: list, epochs: int = EPOCHS) -> Linear:
    """rows: (y, indices, values, ...), read once an epoch; the classes weigh alike in sum."""
    learner = Ftrl(1 << WIDTH, alpha=0.5, l1=0.5, l2=0.1)
    weight = weights_of(rows)
    for _ in range(epochs):
        for y, index, value, *_ in rows:
            at, v = np.append(index, 1 << WIDTH), np.append(value, 1.0)
            w = learner.weights(at)
            w[-1] = learner.model_bias()
            learner.update(at, (sigmoid(float(w @ v)) - y) * weight[y] * v)
    return learner.model()


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3)."""
    rows = Sample(sample(docs, labels, "quality", SAMPLE), features)
    model = fit(rows)
    rows.close()
    return score(docs, model, features, 0.3)
