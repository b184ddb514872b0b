"""The queries of the training-data operators: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import keyed, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secrets import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html_text import fit, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 old shards, by a hash of the id, to 40 of equal rows, written; the digests are of the files read back."""
    from gridloom.llm.reshard import resharded

    return resharded(keyed(table(spark, sf_dir, "documents")), 32, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.media import features

    return features(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.runs import word_runs

    return word_runs(table(spark, sf_dir, "documents"), alter=True)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.url_filter import fit, judge, unwanted

    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit(unwanted(pages)))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_html": op5_html,
    "op6_language": op6_language,
    "op7_reshard": op7_reshard,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_media": op10_media,
    "op11_resample": op11_resample,
    "op12_runs": op12_runs,
    "op13_urls": op13_urls,
}

#: None of them is expressible in SQL at this scale; tests/llm holds each against brute force, a round trip or held-out rows.
SQL: dict[str, str] = {}
