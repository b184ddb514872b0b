"""Near-duplicate classes by ProbMinHash, banding and verification.

Each document's five-word shingles, weighted by how often they come, get a ProbMinHash signature: every shingle is a Poisson process with
its weight as rate, whose arrivals fall on random registers; a register keeps its earliest arrival, and a process ends once its next
arrival is later than every register's. Two documents agree in a register with the probability Jaccard of their weights. Bands of
registers make buckets; documents of a bucket are compared exactly, by weighted Jaccard (sum of lesser weights over sum of greater), and
pairs of at least the threshold are links. The classes are the links' connected components.

Equal texts are one node from the start, so copies cost one row each. Within a bucket, members are compared with a centre; members whose
class is still another one are then compared with further centres, and in buckets of up to SMALL members with every member of another
class. The members of larger buckets that still hold more than one class are joined by a prefix filter, which finds every link between
two classes: of two sets of p and q shingles at least the threshold t alike, t / (1 + t) (p + q) =: o are shared, so the first p - o + 1
and q - o + 1 of them, in any one order, share one. The order is by how many members have a shingle, so that what a template gives to all
comes last. Pairs whose parity bits differ too much are no candidates either. Of what the filter leaves, one pair of each two classes is compared first, as a link makes their other pairs needless. So no two
members of a bucket are left uncompared, save those that the filter proves unlike or that share a class. Hot buckets and hubs are joined by
sort-merge, which adaptive execution splits; hot shingles in salted blocks.

Words: runs of ASCII letters and digits and of characters beyond ASCII, lower case. A text of one to four words has one shingle, of all
its words. A null text is empty; texts without words are one class if they are equal. A null doc_id is kept; a class of such rows only has
a negative id. Repeated rows are copies; `keep_first` keeps one of them, whatever its id. Ties between centres go by hash. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.llm.shared import Words, discard, free_name, keyed, map_rows, mix, ngrams, stored

REGISTERS, BANDS, SMALL, ROUNDS = 144, 24, 32, 2
#: Rounds in which one pair of each two classes is compared, before all pairs of the classes that are still two.
CENTRES = 3
#: Counters of shingles, by hash, for the order of the prefix filter, and those that a row holds; members of a block of a hot shingle.
COUNTERS, SLICE, BLOCK = 1 << 20, 1 << 12, 2000
#: Words of 64 parity bits of a set: each shingle turns one over, so two sets' bits differ in at most as many places as the sets do.
MAPS = 16
MAP = [f"m{k}" for k in range(MAPS)]
#: Nodes whose ids, or pairs of ids, may be broadcast: 8 bytes an id.
BROADCAST_IDS = 1_000_000


def prob_minhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (docs, registers) of uint64: in each register the element of the earliest arrival. doc: of each element, from 0."""
    time = np.full(docs * registers, np.inf)
    holder = np.zeros(docs * registers, np.uint64)
    latest = np.full(docs, np.inf)
    arrival = np.zeros(len(element))
    live = np.arange(len(element))
    step = 0
    while len(live):
        draw = mix(element[live] + np.uint64(step * 0xD1342543DE82EF95 % 2**64))
        now = arrival[live] - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[live]
        early = now < latest[doc[live]]
        live, now, draw = live[early], now[early], draw[early]
        arrival[live] = now
        register = doc[live] * registers + (mix(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, register, now)
        first = time[register] == now
        holder[register[first]] = element[live[first]]
        own = np.unique(doc[live])
        latest[own] = time.reshape(docs, registers)[own].max(1)
        step += 1
    return holder.reshape(docs, registers)


def shingles(texts: list[str | None], n: int = 5) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words; and of each distinct shingle of each text: 40-bit hash, weight, text index; by text, then hash."""
    words = Words(texts)
    hashes, doc = ngrams(words, n)
    key = (doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key, weight = np.unique(key, return_counts=True)
    return words, key & np.uint64((1 << 40) - 1), weight, (key >> np.uint64(40)).astype(np.int64)


def _sketch(rows: dict[str, list]) -> dict[str, object]:
    texts = rows["text"]
    words, element, weight, doc = shingles(texts)
    signature = prob_minhash(element, weight.astype(np.float64), doc, len(texts))
    width = REGISTERS // BANDS
    band = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(texts), 1))
    for k in range(width):
        band = mix(band + signature[:, k::width])
    # a weight of k is k elements, so that sums of lesser and greater weights are sizes of sets
    each = np.repeat(np.arange(len(element)), weight)
    copy = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    flat = np.where(copy > 0, mix(element[each] + copy.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24), element[each])
    owner = doc[each]
    order = np.lexsort((flat, owner))
    flat = flat[order]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    keys, sets = [], []
    for i, t in enumerate(texts):
        own = words.hash[words.first[i] : words.first[i + 1]]
        keys.append(hashlib.md5(own.tobytes() if len(own) else b"text" + (t or "").encode("utf-8", "replace")).digest())
        part = flat[edge[i] : edge[i + 1]]
        sets.append((part >> np.uint64(8)).astype("<u4").tobytes() + part.astype(np.uint8).tobytes())
    some = np.diff(words.first) > 0
    return {"doc_id": rows["doc_id"], "key": keys, "n": np.diff(edge), "bands": [b.tolist() if s else [] for b, s in zip(band.view(np.int64), some)], "shingles": sets}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the words), n (of shingles), bands, shingles (a packed set); and _row, if docs have it."""
    if "_row" in docs.columns:
        return map_rows(docs.select("doc_id", "text", "_row"), "doc_id long, key binary, n int, bands array<long>, shingles binary, _row string", lambda rows: _sketch(rows) | {"_row": rows["_row"]})
    return map_rows(docs.select("doc_id", "text"), "doc_id long, key binary, n int, bands array<long>, shingles binary", _sketch)


def _set(packed: bytes) -> np.ndarray:
    n = len(packed) // 5
    return (np.frombuffer(packed, "<u4", n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(packed, np.uint8, n, 4 * n)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted Jaccard of two packed sets; 0 if both are empty."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = len(x) // 5, len(y) // 5
        if p and q and min(p, q) * 10 >= max(p, q):
            both = len(np.intersect1d(_set(x), _set(y), assume_unique=True))
            out[i] = both / (p + q - both)
    return pd.Series(out)


def components(links: DataFrame) -> DataFrame:
    """links(a, b), both ways or not, to (node, label): the least node of each connected component. Labels spread to neighbours and along labels."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels: DataFrame = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        over = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = stored(spread.join(over, F.col("label") == F.col("at")).select("node", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("was")).alias("moved")), "labels")
        discard(labels)
        if jumped.filter("moved").isEmpty():
            discard(both)
            return jumped.select("node", "label")
        labels = jumped


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label), of all nodes, after further links(a, b): only the links between classes are followed."""
    now = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.join(now("a"), "a").join(now("b"), "b").filter("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    over = components(between).select(F.col("node").alias("label"), F.col("label").alias("next"))
    return stored(labels.join(over, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")


#: A slice of SLICE counters, of which those that are not 0: places (2 bytes each) and numbers (8 bytes each).
SLICED = "slice int, at binary, n binary"


def _sliced(k: int, part: np.ndarray) -> list[pa.Array]:
    return [pa.array([k], pa.int32()), pa.array([np.flatnonzero(part).astype("<u2").tobytes()], pa.binary()), pa.array([part[part > 0].astype("<i8").tobytes()], pa.binary())]


def counted(members: DataFrame) -> DataFrame:
    """SLICED: how many shingles of members(shingles) fall on each of COUNTERS counters, by partition, each of which makes a row a slice, however many sets it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                np.add.at(total, (_set(packed.as_py()) % np.uint64(COUNTERS)).astype(np.int64), 1)
        parts = total.reshape(-1, SLICE)
        for k in np.flatnonzero(parts.any(1)):
            yield pa.RecordBatch.from_arrays(_sliced(k, parts[k]), names=["slice", "at", "n"])

    return members.select("shingles").mapInArrow(run, SLICED)


def _counters(members: DataFrame) -> np.ndarray:
    """How many shingles of members(shingles) fall on each of COUNTERS counters."""

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(rows["at"], rows["n"]):
            total[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(n.as_py(), "<i8")
        return pa.Table.from_arrays(_sliced(rows["slice"][0].as_py(), total), names=["slice", "at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for row in counted(members).groupBy("slice").applyInArrow(added, SLICED).collect():
        out[row["slice"] * SLICE + np.frombuffer(row["at"], "<u2").astype(np.int64)] = np.frombuffer(row["n"], "<i8")
    return out


def prefixes(members: DataFrame, threshold: float) -> DataFrame:
    """Of members(node, shingles) the shingles of each one's prefix, rarest first: token, node, n (of shingles), pos; and MAPS words of the set's parity bits."""
    held = members.sparkSession.sparkContext.broadcast(_counters(members))

    def prefix(rows: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("token", "node", "n", "pos", *MAP)}
        for node, packed in zip(rows["node"], rows["shingles"]):
            own = _set(packed)
            count = held.value[(own % np.uint64(COUNTERS)).astype(np.int64)]
            n = len(own)
            order = np.lexsort((own, count))[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
            pos = np.flatnonzero(count[order] > 1)  # one alone is nobody else's
            parity = np.packbits(np.bincount((own & np.uint64(64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1).view(np.int64)
            for k, v in zip(out, (own[order[pos]].astype(np.int64), [node] * len(pos), [n] * len(pos), pos, *[[m] * len(pos) for m in parity])):
                out[k].extend(v)
        return out

    return map_rows(members.select("node", "shingles"), "token long, node long, n int, pos int, " + ", ".join(f"{m} long" for m in MAP), prefix)


def _fits(threshold: float) -> Column:
    """Whether a token's holders x and y are of two labels, both have it early enough for a pair of the threshold, and their parity bits differ
    in no more places than the shingles of such a pair that only one of them has."""
    shared = F.ceil(threshold / (1 + threshold) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    return (F.col("x_label") != F.col("y_label")) & (F.col("x_pos") <= F.col("x_n") - shared) & (F.col("y_pos") <= F.col("y_n") - shared) & (reduce(add, [F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MAP]) <= F.col("x_n") + F.col("y_n") - 2 * shared)


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """members(node, label, shingles) to the pairs (a, b) of two labels that a prefix filter can't prove less alike than the threshold."""
    return paired(stored(prefixes(members, threshold).join(members.select("node", "label"), "node"), "prefixes"), threshold).select("a", "b")


def paired(tokens: DataFrame, threshold: float) -> DataFrame:
    """tokens(token, node, label, n, pos) to all pairs (a, b) of two labels that the prefix filter lets pass; with a_label, b_label, and shared, the tokens of both."""
    # a shingle's largest class isn't joined with itself, so the comparisons are at most twice the pairs of two classes
    each = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    hot = each.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    marked = stored(tokens.join(hot.select("token", "most", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "token"), "marked")
    share = threshold / (1 + threshold)
    small = marked.filter(F.col("pos") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9)).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = (df.select("token", "salt", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "label", "n", "pos", *MAP)], (F.col("label") == F.col("most")).alias(f"{side}_most")) for df, side in ((small, "x"), (large, "y")))
    fits = _fits(threshold) & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node"))))
    met = x.filter("not x_most").join(y, ["token", "salt"]).filter(fits).unionByName(x.filter("x_most").join(y.filter("not y_most"), ["token", "salt"]).filter(fits))
    ahead = F.col("x_node") < F.col("y_node")
    each = [F.when(ahead, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(n) for c, n in (("node", "a"), ("label", "a_label"))] + [F.when(ahead, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(n) for c, n in (("node", "b"), ("label", "b_label"))]
    return met.select(*each).groupBy("a", "b", "a_label", "b_label").agg(F.count(F.lit(1)).alias("shared"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs(a_label, b_label, ..) without those whose classes of then have since become one; the classes are looked up, not the pairs."""
    now = lambda side: labels.select(F.col("node").alias(f"{side}_label"), F.col("label").alias(f"{side}_now"))
    kinds = pairs.select("a_label", "b_label").distinct().join(now("a"), "a_label", "left").join(now("b"), "b_label", "left")
    one = kinds.filter(F.coalesce("a_now", "a_label") == F.coalesce("b_now", "b_label")).select("a_label", "b_label")
    return pairs.join(stored(one, "one"), ["a_label", "b_label"], "left_anti")


def _joined(df: DataFrame, ids: DataFrame, on: str, count: int, how: str = "inner") -> DataFrame:
    """df joined with ids, or pairs of them, which are broadcast if they are at most BROADCAST_IDS."""
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, on, how)


def classes(docs: DataFrame, threshold: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size (rows of its class)."""
    rows, ids = _classes(docs.select("doc_id", "text"), threshold, rounds)
    return rows.join(ids, "label").select("doc_id", F.coalesce("least", -1 - F.col("label")).alias("class_id"), "class_size")


def _classes(docs: DataFrame, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: of each row doc_id, row, label and, if docs have it, _row; and of each label least (doc_id), class_size and first (row of the least doc_id)."""
    sketch = stored(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketch")
    nodes = stored(sketch.groupBy("key").agg(F.min("row").alias("node")), "nodes")
    alone = _joined(sketch.select("row", "bands"), nodes.select(F.col("node").alias("row")), "row", nodes.count())
    members = alone.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"))
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node"))
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(order)["node"].alias("centre")).filter("size > 1")
    # a table of its own, here and below: it is broadcast while it is small, and beyond that both sides are shuffled and a hot bucket can be split
    size = stored(size, "sizes")
    shared = stored(_joined(members, size, "bucket", size.count()), "buckets")
    pairs = shared.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    involved = stored(shared.select("node").distinct(), "involved")
    sets = stored(_joined(sketch.select(F.col("row").alias("node"), "shingles"), involved, "node", involved.count()), "sets")

    def verified(some: DataFrame) -> DataFrame:
        """The pairs (a, b) that are as alike as the threshold. Pairs are ids, so they go to the sets while they may be broadcast; of the
        sets only those that a pair names are shuffled, for the second of the two joins."""
        asked = stored(some.select("a", "b"), "asked")
        n = asked.count()
        left = _joined(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), asked, "a", n)
        named = _joined(sets, asked.select(F.col("b").alias("node")).distinct(), "node", n, "left_semi")
        both = left.join(named.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        out = stored(both.filter(similarity("x", "y") >= F.lit(threshold)).select("a", "b"), "verified")
        discard(asked)
        return out

    found = components(verified(pairs))
    labels = stored(involved.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    for k in range(1, rounds):
        marked = shared.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label"))
        draw = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node"), F.col("label"))
        open_ = marked.groupBy("bucket").agg(F.min(draw).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket", F.col("c.node").alias("centre"), F.col("c.label").alias("of"))
        apart = stored(marked.join(stored(open_, "unlike"), "bucket"), "apart")
        pairs = apart.filter("label <> of").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        if k == 1:
            few = apart.filter(F.col("size") <= SMALL)
            other = few.select("bucket", F.col("node").alias("b"), F.col("label").alias("other"))
            pairs = pairs.union(few.join(other, "bucket").filter((F.col("label") != F.col("other")) & (F.col("node") < F.col("b"))).select(F.col("node").alias("a"), "b"))
        more = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if more.isEmpty():
            break
        labels = merged(labels, more)
    marked = shared.filter(F.col("size") > SMALL).join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    left = stored(marked.join(stored(open_, "unlike"), "bucket").select("node").distinct(), "open")
    if not left.isEmpty():
        tokens = prefixes(stored(sets.join(left, "node"), "members"), threshold)
        own = stored(tokens.join(labels, "node", "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label"), *MAP), "prefixes")
        pairs = stored(paired(own, threshold), "pairs")
        for k in range(CENTRES):  # one pair of each two classes: where it links them, their other pairs need no comparison
            likely = F.struct(F.col("shared") if k == 0 else F.lit(0), F.xxhash64("a", "b", F.lit(k)))
            best = pairs.groupBy("a_label", "b_label").agg(F.max_by(F.struct("a", "b"), likely).alias("p")).select("p.a", "p.b")
            more = verified(best)
            if more.isEmpty():
                break
            labels = merged(labels, more)
            pairs = stored(_apart(pairs, labels), "pairs")
        labels = merged(labels, verified(pairs))
    named = nodes.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    rows = stored(sketch.join(named, "key").select("doc_id", "row", "label", *[c for c in sketch.columns if c == "_row"]), "labelled")
    # a table of its own, so that the join with it shuffles both sides and a large class can be split
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    ids = stored(rows.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"), first["row"].alias("first")), "ids")
    discard(sketch, nodes, size, shared, involved, sets)
    return rows, ids


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate class, that of the least doc_id (null ids last), and the first of rows with equal ids; all columns stay."""
    key = free_name(docs, "_row")
    own = keyed(docs, key)
    rows, ids = _classes(own.select("doc_id", "text", F.col(key).alias("_row")), threshold, ROUNDS)
    extra = stored(rows.join(ids.select(F.col("first").alias("row")), "row", "left_anti").select(F.col("_row").alias(key)), "copies")
    return _joined(own, extra, key, extra.count(), "left_anti").select(*docs.columns)
