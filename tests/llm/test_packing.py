import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import packing
from gridloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_library(library):
    from gridloom.llm.bpe import Encoder

    r = random.Random(3)
    signs = list("ab'st rell  \n\t.1é日ＤvmD_-  ") + ["\U0001f600", "<|endoftext|>", "'re", "'ll"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 25))) for _ in range(4000)] + ["don't we'll 'tis\n's l'enfant d'ss", "", " "]
    own = Encoder(tokenizer_path()).encode(texts)
    assert [a.tolist() for a in own] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts, library, capacity=2048):
    """Each id lies in exactly one piece, sequences are gapless and not too long."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, own in of.items():
        if doc is None or doc not in texts:
            continue
        text, times = texts[doc]
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sorted((r["start"], r["length"]) for r in own)[0][0] == 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_pack(spark, medium, library):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = packing.pack(docs, tokenizer_path()).collect()
    n, total = check(rows, {r["doc_id"]: (r["text"], 1) for r in docs.collect()}, library)
    assert total / (n * 2048) > 0.98


def test_odd_rows(odd_docs, no_docs, library):
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    texts = {r["doc_id"]: (r["text"], 2 if r["doc_id"] == 1 else 1) for r in odd_docs.collect() if r["doc_id"] is not None}
    check(rows, texts, library)
    assert {r["doc_id"] for r in rows} == {None, *texts}
    assert packing.pack(no_docs, tokenizer_path()).collect() == []


def test_column_generation_reaches_the_bound():
    r = np.random.default_rng(0)
    width, demand = np.unique(np.ceil(r.uniform(1, 128, 3000)).astype(int), return_counts=True)
    patterns, used, value = packing.solve(width, demand, 128)
    held = sum(u * p for u, p in zip(used, patterns))
    assert np.allclose(held, demand) and all((p * width).sum() <= 128 for p in patterns)
    least = (width * demand).sum() / 128
    plan = packing.plan(width, demand, 128)
    assert least <= value + 1e-6 and plan.sequences <= np.ceil(value) + len(width)
    place = np.concatenate([plan.place(np.full(n, k), np.arange(n)) for k, n in enumerate(demand)])
    fill = np.bincount(place, np.repeat(width, demand))
    assert fill.max() <= 128 and len(fill) == plan.sequences


def test_small_optimum():
    plan = packing.plan(np.array([3, 5, 7]), np.array([2, 2, 2]), 10)
    assert plan.sequences == 3  # 7+3, 7+3, 5+5


def test_short_texts_fill_their_sequences(spark):
    """Texts of a few ids, equal or missing ids among them, take no more sequences than their sum of ids asks for, by 2 %."""
    for texts in (["", None] * 600, ["one", "a b", "x y z w", "", "longer words than those before"] * 700, [" ".join(["w"] * (k % 60)) for k in range(900)]):
        docs = spark.createDataFrame([(None if k % 3 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
        rows = packing.pack(docs, tokenizer_path()).collect()
        total, used = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
        assert len(rows) == len(texts) and used <= 1 + 1.02 * total / 2048
        own = {}
        for r in rows:
            own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in own.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048


def test_bundles_lose_little():
    for length in range(1, 256):
        n = packing.bundle(length, 8)
        lost = -(-n * length // 8) * 8 - n * length
        assert n * length <= 512 and (lost == 0 if length < 64 else lost < n * length / 32)
