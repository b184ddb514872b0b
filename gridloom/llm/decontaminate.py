"""Benchmark decontamination in DataFrame functions: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters and digits, lower case; shingles are five words, weighted by how often they come. A document's windows are runs
of as many words as an item has. A window can only be similar to an item if they share a shingle, so windows are laid where a shingle of
an item stands in the text, in the place that it has in the item; no similar window that lies so is left out, and all others are never made.
Windows and items get 64-bit SimHash fingerprints of their shingles. A fingerprint is split into BLOCKS blocks; two fingerprints
within RADIUS differ by at most RADIUS // BLOCKS bits in some block, so items are entered under every block value within that distance,
windows look up their own values, and every pair within the radius meets. Pairs of equal window size within the radius are verified by the
exact weighted Jaccard similarity of their shingles.

An item of one to four words has one shingle, of all its words, and is looked for in windows of that length, where it must stand word for word.

Nulls: a null text is empty and holds nothing; an item with a null text or without words is never found. Rows, of documents and of items,
are told apart by a key of their own up to the last step, so null and repeated ids lose nothing: `leaks` gives one row per doc_id and item_id
(null is an id), with the best window of all rows of that id; ties go to the first window. `clean` judges each row by itself. Very long texts
are read whole. Empty tables give an empty result. Other columns are not read; `clean` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import free_name, keyed, stored

N, BITS, BLOCKS, RADIUS = 5, 64, 9, 17
#: Shingles of the benchmark that may be broadcast: some 24 bytes each.
BROADCAST_SHINGLES = 1_000_000
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """The words, as an array of strings."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs(of: Column, n: int) -> Column:
    """The hash of each run of n words; an empty array if there are fewer."""
    return F.when(F.size(of) >= n, F.transform(F.slice(of, 1, F.greatest(F.size(of) - (n - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(of, i + k) for k in range(1, n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(of: Column) -> Column:
    """The hash of each run of N words; of fewer words, of all of them; an empty array without words."""
    out = runs(of, N)
    for n in range(1, N):
        out = F.when(F.size(of) == n, runs(of, n)).otherwise(out)
    return out


def fingerprints(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys and fp: bit k is 1 if more of the shingle hashes, as often as they come, have it than not."""
    bits = df.select(*keys, F.explode(hashes).alias("_h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(1))).alias(f"_b{k}") for k in range(BITS)])
    fp = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
        fp = fp.bitwiseOR(F.when(F.col(f"_b{k}") * 2 > F.col("_n"), bit).otherwise(F.lit(0).cast("long")))
    return bits.select(*keys, fp.alias("fp"))


def _bounds() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edge = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def block_values(fp: Column, near: bool) -> Column:
    """An array of (block, value); near: with every value that differs in RADIUS // BLOCKS bits at most (which is one here)."""
    out = []
    for k, (at, width) in enumerate(_bounds()):
        own = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        values = [own, *[own.bitwiseXOR(F.lit(1 << i)) for i in range(width)]] if near else [own]
        out += [F.struct(F.lit(k).alias("block"), v.alias("value")) for v in values]
    assert RADIUS // BLOCKS == 1
    return F.array(*out)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of lesser counts over sum of greater counts of two arrays of hashes."""
    plain = F.size(F.array_intersect(a, b))
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    exact = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    both = F.when((F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b)), plain).otherwise(exact)
    return both / (F.size(a) + F.size(b) - both)


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """docs(_row, doc_id, text) to _row, doc_id, item_id, start, length, hamming, similarity of each window that is similar to an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.size("w").cast("int").alias("length"), shingles(F.col("w")).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = items.select("length", F.posexplode("item_hashes").alias("at", "h")).distinct()
    few = seeds.count() <= BROADCAST_SHINGLES
    short = sorted(r["length"] for r in items.filter(F.col("length") < N).select("length").distinct().collect())
    own = docs.select("_row", "doc_id", words(F.col("text")).alias("w")).filter(F.size("w") >= min([N, *short]))

    def places(of: DataFrame, *kept: str) -> DataFrame:
        """Each run of words of the sizes in question, with its place and hash."""
        each = lambda n: F.transform(runs(F.col("w"), n), lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(n).alias("n")))
        every = each(N)
        for n in short:
            every = F.concat(every, each(n))
        return of.select(*kept, F.inline(every))

    fits = F.least(F.col("length"), F.lit(N)) == F.col("n")
    if few:
        hits = places(own, "_row", "doc_id", "w").join(F.broadcast(seeds), "h").filter(fits)
    else:  # only hashes are shuffled; the words are joined to what is hit
        own = stored(own, "words")
        hit = places(own, "_row").join(seeds, "h").filter(fits).select("_row", "pos", "at", "length").distinct()
        hits = hit.join(own, "_row")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("w") - F.col("length")))
    laid = hits.select("_row", "doc_id", start.alias("start"), "length", F.expr("slice(w, int(greatest(0, least(pos - at, size(w) - length))) + 1, length)").alias("w"))
    one = laid.groupBy("_row", "start", "length").agg(F.first("doc_id").alias("doc_id"), F.first("w").alias("w"))  # a row has one id, and one text at a place
    windows = stored(one.select("_row", "doc_id", "start", "length", shingles(F.col("w")).alias("hashes")).withColumn("window", F.monotonically_increasing_id()), "windows")
    left = fingerprints(windows.select("window", "length", "hashes"), ["window", "length"], "hashes").select("window", "length", "fp", F.inline(block_values(F.col("fp"), False)))
    right = fingerprints(items, ["item", "length"], "item_hashes").select("item", "length", F.col("fp").alias("item_fp"), F.inline(block_values(F.col("fp"), True)))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = left.join(right, ["length", "block", "value"]).filter(hamming <= RADIUS).select("window", "item", hamming.alias("hamming")).distinct()
    pairs = met.join(windows, "window").join(items.select("item", "item_id", "item_hashes"), "item")
    return pairs.select("_row", "doc_id", "item_id", "start", "length", "hamming", weighted_jaccard(F.col("hashes"), F.col("item_hashes")).alias("similarity")).filter(F.col("similarity") >= threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document and item of it: doc_id, item_id, start (first word of the best window), length (its words), hamming, similarity."""
    scored = _found(keyed(docs.select("doc_id", "text")), benchmark, threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "length", "hamming")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.hamming").alias("hamming"), (-F.col("b.s")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows whose text holds an item; all columns and all other rows stay, whatever their ids."""
    key = free_name(docs, "_row")
    rows = keyed(docs, key)
    found = stored(_found(rows.select(F.col(key).alias("_row"), "doc_id", "text"), benchmark, threshold).select(F.col("_row").alias(key)).distinct(), "leaks")
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, key, "left_anti").select(*docs.columns)
