"""What the training-data operators have in common: tables, the shared folder, text batches, word hashes, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gridloom.functions.scalar import bounded

#: Rows of one Arrow batch; texts can be long.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch, more only by its last row.
BATCH_BYTES = 8_000_000
#: Bytes of text handled at once inside a batch.
SLICE_BYTES = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set here only where it is unset, and only in local mode: on a cluster no machine reads another's folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no result still to be computed reads."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with a number, so that no column of df is called so."""
    taken, k, out = {c.lower() for c in df.columns}, 0, name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def keyed(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a string column `name` that tells rows apart and is the same in every scan: a row's file and its place there.

    docs that aren't files, or whose own columns hide the files' metadata, are stored first, under a numbering of their rows.
    """
    if "_metadata" not in docs.columns and docs.inputFiles():
        try:
            return docs.select("*", F.concat_ws(":", F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")).alias(name))
        except AnalysisException:
            pass
    return stored(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "keyed")


def hash_sample(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """rows(key, group), one row a key, with `_r`, from 1: the `most` first of each group by a hash of the key.

    A group's count gives a bound of the hash that some 1.5 times `most` rows pass, so that what is ranked, in one task a group, does not
    grow with the table. The counts are one row a group, and the first `most` are below the bound but for a chance of 1 in 10^9.
    """
    share = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = rows.groupBy(group).agg((F.lit(1.5 * most + 50) / F.count(F.lit(1))).alias("_share"))
    near = rows.join(bounded(counts), group).filter(share < F.col("_share")).drop("_share")  # so the rows beyond the bounds are not shuffled
    order = Window.partitionBy(group).orderBy(share, key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _slices(texts: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of at most SLICE_BYTES in sum, or of one row."""
    lo, total = 0, 0
    for i, s in enumerate([*texts, None]):
        if s is None or (total and total + s > SLICE_BYTES):
            if i > lo:
                yield lo, i
            lo, total = i, 0
        total += s or 0


def map_rows(df: DataFrame, schema: str, function: Callable[[dict[str, list]], dict[str, object]]) -> DataFrame:
    """mapInArrow with columns as lists, at most SLICE_BYTES of text (or one row) per call. The function returns the columns of schema."""
    target = _arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for lo, hi in _slices([sum(len(v) for v in row if isinstance(v, str)) for row in zip(*columns.values())]):
                out = function({n: c[lo:hi] for n, c in columns.items()})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, function: Callable[[list[str | None]], list | np.ndarray], replace: bool) -> DataFrame:
    """df with its column `text` replaced by what the function makes of it, or the rows for which the function gives true. All other
    columns, of whatever type, pass as the Arrow columns that they are."""
    place = df.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            made: list = []
            for lo, hi in _slices([len(t or "") for t in texts]):
                made += list(function(texts[lo:hi]))
            if replace:
                column = pa.array(made, batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            else:
                yield batch.filter(pa.array(made, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


# ---------------------------------------------------------------- words

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a list of texts: runs of ASCII letters and digits and of all characters beyond ASCII, lower case.

    buf: UTF-8 bytes; start, end: of each word; doc: its text; hash: uint64; first: index of each text's first word, and the end.
    """

    def __init__(self, texts: list[str | None], lower: bool = True) -> None:
        parts = [(t.lower() if lower else t).encode("utf-8", "replace") if t else b"" for t in texts]
        self.buf = buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        edge = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        word = _WORD[buf]
        step = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        self.start, self.end = step[::2], step[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, edge))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        longest = int(length.max())
        power = np.ones(longest, np.uint64)
        np.multiply.accumulate(np.full(longest - 1, _BASE, np.uint64), out=power[1:]) if longest > 1 else None
        at = np.repeat(self.start, length)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        terms = (self.buf[at + inside].astype(np.uint64) + np.uint64(1)) * power[inside]
        return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the runs of n words inside each text; a text of 1 to n-1 words has one run, of all of them."""
    h, first = words.hash, words.first
    count = np.diff(first)
    total = len(h)
    combined = np.zeros(total, np.uint64)
    for j in range(n):
        factor = np.uint64((2 * (j + 1) * 0x9E3779B97F4A7C15 + 1) % 2**64)
        combined[: total - j] += h[j:] * factor if j else h * factor
    keep = np.ones(total, bool)
    left = first[1:][words.doc] - np.arange(total)
    keep &= left >= n
    out, doc = mix(combined[keep]), words.doc[keep]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            own = h[first[d] : first[d + 1]]
            factors = np.array([(2 * (j + 1) * 0x9E3779B97F4A7C15 + 1) % 2**64 for j in range(len(own))], np.uint64)
            extra[k] = (own * factors).sum(dtype=np.uint64) + np.uint64(len(own))
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


# ---------------------------------------------------------------- ranks


def ranked(df: DataFrame, group: list[str], salt_of: list[str], order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """df with a gapless rank from 0 within each group, without a task that holds a whole group.

    Rows of a group are dealt by a hash of salt_of over many salts; a row's rank is its number within its salt plus the rows of the
    salts before. rows: of df, to choose the number of salts so that a group of all rows has some 20,000 a salt at most.
    """
    salts = max(128, min(1 << 20, rows // 20_000))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)))
    keys = [*group, "_salt"]
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = numbered.alias("a").join(offsets.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._rn") - 1 + F.col("b._offset")).cast("long").alias(out))
