import random

from test_decontaminate import brute as leaks_of
from test_models import FOREIGN, garbled
from test_neardup import brute as classes_of
from test_secrets import brute as secrets_of

import corpus_pipeline as P


def test_stages_and_their_decisions(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").filter("doc_id < 200")
    r = random.Random(6)
    planted = {1_000_000 + k: t for k, t in enumerate([*FOREIGN, *(garbled(r) for _ in range(4)), None, "", "12 34"])}
    docs = spark.createDataFrame([*docs.collect(), *[(i, t, None, "planted", len(t or "")) for i, t in planted.items()]], docs.schema).repartition(4)
    kept = docs
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, medium).collect(), docs.schema)
        rows = {r["doc_id"]: r for r in kept.collect()}
        assert kept.columns == docs.columns and len(rows) == kept.count()
        ids = sorted(before)
        texts = {i: before[i]["text"] for i in ids}
        if name == "language":
            assert not set(rows) & set(planted) and len(rows) >= 0.98 * 200
        elif name == "near_duplicates":
            assert set(rows) == {ids[k] for k in set(classes_of([texts[i] for i in ids]))}
        elif name == "benchmark":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
            assert set(rows) == set(before) - {d for d, _ in leaks_of(texts, items)}
        elif name == "redaction":
            assert set(rows) == set(before)
            for i in ids:
                assert (rows[i]["text"] == texts[i]) == (not secrets_of(texts[i])) and rows[i]["n_chars"] == len(rows[i]["text"]) and not secrets_of(rows[i]["text"])
        before = rows
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, kept, medium).collect()} == set(before)


def test_run(spark, small):
    rows = P.run(spark, small).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert 4 <= len(P.STAGES) <= 5


def test_odd_and_no_rows(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, no_docs):
        names = docs.columns
        for name, stage in P.STAGES:
            before, out = docs.count(), stage(spark, docs, small)
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.columns == names or name == "sequences"
            assert docs.count() <= before or name == "sequences"
        assert docs.isEmpty() == (before == 0)
