"""Language identification by interpolated Kneser-Ney character models.

For each language, the character n-grams of its training words, with a space before and after, make a model of orders 1 to ORDER: the
highest order has counts, the lower ones numbers of distinct left neighbours (counts where a word begins), each with its own discount, all
interpolated. The n-grams of all languages are one sorted array of hashes with a column of discounted probabilities for each language; the
contexts are another, with the weights left for the lower order. A text's cross-entropy in a language is the mean over its words'
characters, numbers apart; the language of the lowest is chosen. A batch's distinct words are scored once, and remembered by the worker.

The models are fitted on at most SAMPLE / 2 documents of each language, of those whose crc32(doc_id) mod 5 is not 0; the rest of the corpus
is scored, whole. Rejection is calibrated on as many documents that no model has seen, as multiples of the median cross-entropy of those that
go to the same language: a language's limit is its median times the multiple that only the share FALSE_REJECTION of them all exceeds; or, if
that is higher, as it is where the documents are few, times what a normal distribution of the logarithms gives. Labels are taken at their
word: other text labelled as a language widens the limits. A text over the limit of its best language is rejected; so is one without a letter.

Nulls and texts without a letter are `und`, with score 0. A text with letters gets a learned language; without any training row all are `und`. Ties go to the
language first in order. Repeated rows get equal results; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import Words, discard, fold, hash_sample, map_rows, map_texts, mix, stored

ORDER = 5
#: Documents of each language at most; every second one trains, the others calibrate.
SAMPLE = 2000
#: The share of a language's own documents that calibration lets be rejected.
FALSE_REJECTION = 0.001
REMEMBERED = 250_000
#: New words that are scored at once.
AT_ONCE = 10_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters of all ' word ' in a row the hashes of the 1- to ORDER-grams that end at each; and for each character after a word's
    first space its place in that row, its word's index, and how many of the orders exist there. The context of a gram of n characters is the
    gram of n - 1 that ends one place before."""
    joined = "".join(f" {w} " for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(length) - length
    inside = np.arange(len(code)) - np.repeat(first, length)
    grams = np.zeros((ORDER + 1, len(code)), np.uint64)
    for n in range(1, min(ORDER, len(code)) + 1):  # hash of the n characters that end at each place, from those of n - 1 that end there
        grams[n, n - 1 :] = mix(grams[n - 1, n - 1 :] + (code[: len(code) - n + 1] + np.uint64(1)) * _SEED + np.uint64(n))
    here = np.flatnonzero(inside > 0)
    return grams, here, np.repeat(np.arange(len(words)), length)[here], np.minimum(inside[here] + 1, ORDER)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, by character: word index, hashes of the grams that end there, how many of the orders exist there, hashes of the contexts."""
    grams, here, word, orders = _places(words)
    return word, grams[:, here], orders, grams[:, here - 1]


def train(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams and their discounted probabilities; sorted hashes of contexts and the weights of the lower order."""
    grams, here, word, orders = _places(words)
    weight = counts[word].astype(np.float64)
    keys, probabilities, heads, rests = [], [], [], []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(orders >= n)
        key, one, which = np.unique(grams[n, here[at]], return_index=True, return_inverse=True)
        count = np.bincount(which, weight[at], len(key))
        if n < ORDER:  # distinct left neighbours; a gram that begins a word has none and keeps its count
            longer = np.flatnonzero(orders >= n + 1)
            wide, first = np.unique(grams[n + 1, here[longer]], return_index=True)
            left = np.zeros(len(key))
            np.add.at(left, np.searchsorted(key, grams[n, here[longer[first]]]), 1.0)
            starts = np.zeros(len(key))
            begin = orders[at] == n
            np.add.at(starts, which[begin], weight[at][begin])
            count = left + starts
        context = grams[n - 1, here[at[one]] - 1] if n > 1 else np.zeros(len(key), np.uint64)
        head, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, count, len(head)), np.bincount(inverse, minlength=len(head))
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        discount = min(discount, float(count.min()) if len(count) else 0.5)
        keys.append(key)
        probabilities.append((count - discount) / total[inverse])
        heads.append(mix(head + np.uint64(n)))
        rests.append(discount * kinds / total)
    key, head = np.concatenate(keys), np.concatenate(heads)
    o, p = np.argsort(key), np.argsort(head)
    return key[o], np.concatenate(probabilities)[o], head[p], np.concatenate(rests)[p]


@dataclass
class Model:
    """Sorted hash arrays with a column for each language."""

    languages: list[str]
    keys: np.ndarray
    probability: np.ndarray
    heads: np.ndarray
    rest: np.ndarray
    letters: int
    #: Cross-entropy beyond which a text of each language is rejected.
    limit: np.ndarray

    @staticmethod
    def of(parts: dict[str, tuple]) -> "Model":
        languages = sorted(parts)
        keys = np.unique(np.concatenate([parts[x][0] for x in languages]))
        heads = np.unique(np.concatenate([parts[x][2] for x in languages]))
        probability, rest = np.zeros((len(keys), len(languages)), np.float32), np.ones((len(heads), len(languages)), np.float32)
        for k, x in enumerate(languages):
            probability[np.searchsorted(keys, parts[x][0]), k] = parts[x][1]
            rest[np.searchsorted(heads, parts[x][2]), k] = parts[x][3]
        return Model(languages, keys, probability, heads, rest, 5000, np.full(len(languages), np.inf))

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: bits in each language, and characters (with the space after)."""
        grams, here, word, orders = _places(words)
        p = np.full((len(word), len(self.languages)), 1.0 / self.letters)
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(orders >= n)
            head = mix((grams[n - 1, here[at] - 1] if n > 1 else np.zeros(len(at), np.uint64)) + np.uint64(n))
            place = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
            rest = np.where((self.heads[place] == head)[:, None], self.rest[place], 1.0)
            gram = grams[n, here[at]]
            place = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
            own = np.where((self.keys[place] == gram)[:, None], self.probability[place], 0.0)
            p[at] = own + rest * p[at]
        cost = -np.log2(np.maximum(p, 1e-12))
        out = np.stack([np.bincount(word, cost[:, k], len(words)) for k in range(len(self.languages))], 1)
        return out, np.bincount(word, minlength=len(words)).astype(np.float64)


class Scorer:
    """Cross-entropies of texts; the words seen are remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages) + 1))
        self.late: tuple[np.ndarray, np.ndarray] = self.keys, self.values

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): bits a character; infinite for a text without words."""
        words = Words(texts)
        key, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        value = np.full((len(key), self.values.shape[1]), np.nan)
        for keys, values in ((self.keys, self.values), self.late):
            if len(keys) and len(key):
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                value[hit] = values[place[hit]]
        unknown = np.flatnonzero(np.isnan(value[:, 0]))
        buf = words.buf.tobytes() if len(unknown) else b""
        for new in (unknown[k : k + AT_ONCE] for k in range(0, len(unknown), AT_ONCE)):
            own = [buf[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())]
            bits, size = self.model.bits(own)
            spoken = np.array([not w.isdigit() for w in own], float)[:, None]
            value[new] = np.column_stack([bits, size]) * spoken
            self.late = self._merged(self.late, (key[new], value[new]))
            if len(self.late[0]) > 20_000 + len(self.keys) // 4:
                self.keys, self.values = self._merged((self.keys, self.values), self.late)
                self.late = self.keys[:0], self.values[:0]
        total = np.stack([np.bincount(words.doc, value[which, k], len(texts)) for k in range(value.shape[1])], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total[:, -1:] > 0, total[:, :-1] / total[:, -1:], np.inf)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


def sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE documents of each language: lang, text, trains. Ids and languages alone are ranked; of an id's several texts one is read."""
    own = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = hash_sample(own.select("doc_id", "lang").distinct(), "doc_id", "lang", SAMPLE)
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.first("_r").alias("_r"))
    return rows.select("lang", "text", (F.col("_r") % 2 == 1).alias("trains"))


def fit(docs: DataFrame) -> Model | None:
    """The models of the languages in docs (doc_id, text, lang); None if there is no row to learn from. The sample's words are counted
    first; a language's distinct ones, with their counts, are one task's."""

    def counted(rows: dict[str, list]) -> dict[str, object]:
        words, out = Words(rows["text"]), {"lang": [], "word": [], "n": []}
        buf = words.buf.tobytes()
        for k, lang in enumerate(rows["lang"]):
            lo, hi = words.first[k], words.first[k + 1]
            _, first, count = np.unique(words.hash[lo:hi], return_index=True, return_counts=True)
            own = [buf[a:b].decode("utf-8", "replace") for a, b in zip(words.start[lo + first].tolist(), words.end[lo + first].tolist())]
            spoken = [(w, c) for w, c in zip(own, count.tolist()) if not w.isdigit()]
            out["lang"] += [lang] * len(spoken)
            out["word"] += [w for w, _ in spoken]
            out["n"] += [c for _, c in spoken]
        return out

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        part = train(rows["word"].tolist(), rows["n"].to_numpy())
        data = b"".join([np.int64(len(part[0])).tobytes(), np.int64(len(part[2])).tobytes(), part[0].tobytes(), part[1].astype("<f4").tobytes(), part[2].tobytes(), part[3].astype("<f4").tobytes()])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "part": [data]})

    chosen = stored(sample(docs), "languages")
    words = map_rows(chosen.filter("trains").select("lang", "text"), "lang string, word string, n long", counted).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = {}
    for row in words.groupBy("lang").applyInPandas(one, "lang string, part binary").collect():
        data = bytes(row["part"])
        n, m = np.frombuffer(data, np.int64, 2)
        at, arrays = 16, []
        for kind, size in (("<u8", n), ("<f4", n), ("<u8", m), ("<f4", m)):
            arrays.append(np.frombuffer(data, kind, size, at))
            at += arrays[-1].nbytes
        parts[row["lang"]] = tuple(arrays)
    if not parts:
        return None
    model = Model.of(parts)
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def unseen(rows: dict[str, list]) -> dict[str, object]:
        entropy = _scorer(key, held.value).entropies(rows["text"])
        entropy = entropy[np.isfinite(entropy[:, 0])]
        return {"k": entropy.argmin(1), "bits": entropy.min(1)}

    found = map_rows(chosen.filter("not trains").select("text"), "k int, bits double", unseen).collect()  # at most SAMPLE / 2 numbers a language
    discard(chosen)
    model.limit = limits(np.array([r["k"] for r in found], int), np.array([r["bits"] for r in found]), len(model.languages))
    return model


def limits(k: np.ndarray, bits: np.ndarray, languages: int) -> np.ndarray:
    """Each language's limit from the cross-entropies of unseen texts whose best language is k; a language without such texts has the highest of the others."""
    if not len(bits):
        return np.full(languages, np.inf)
    middle = np.array([np.median(bits[k == x]) if (k == x).any() else np.nan for x in range(languages)])
    multiple = bits / middle[k]
    tail = np.exp(NormalDist().inv_cdf(1 - FALSE_REJECTION) * np.log(np.maximum(multiple, 1e-9)).std())
    most = max(np.quantile(multiple, 1 - FALSE_REJECTION, method="higher"), tail)
    return most * np.where(np.isnan(middle), np.nanmax(middle), middle)


_scorers: dict[str, Scorer] = {}


def _scorer(key: str, model: Model) -> Scorer:
    """The worker's scorer of the model that the key names; one is kept."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the chance of the language among the learned ones, by the first 50
    characters' worth of evidence), entropy, rejected."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(rows: dict[str, list]) -> dict[str, object]:
        texts = rows["text"]
        out = {"doc_id": rows["doc_id"], "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "entropy": [None] * len(texts), "rejected": [True] * len(texts)}
        if held.value is None:
            return out
        entropy = _scorer(key, held.value).entropies(texts)
        for i, t in enumerate(texts):
            if t and np.isfinite(entropy[i, 0]) and any(map(str.isalpha, t)):
                k = int(entropy[i].argmin())
                chance = np.exp2(-50 * (entropy[i] - entropy[i, k]))
                for c, v in (("lang_pred", held.value.languages[k]), ("score", float(1 / chance.sum())), ("entropy", float(entropy[i, k])), ("rejected", bool(entropy[i, k] > held.value.limit[k]))):
                    out[c][i] = v
        return out

    found = map_rows(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, entropy double, rejected boolean", run)
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that are rejected; all columns and repeated rows stay. No join: each row is judged where it is."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def known(texts: list[str | None]) -> list[bool]:
        if held.value is None:
            return [False] * len(texts)
        entropy = _scorer(key, held.value).entropies(texts)
        under = entropy.min(1) <= held.value.limit[entropy.argmin(1)]
        return [bool(u) and bool(t) and any(map(str.isalpha, t)) and bool(np.isfinite(e)) for u, t, e in zip(under, texts, entropy[:, 0])]

    return map_texts(docs, known, replace=False)
