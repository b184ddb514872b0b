"""Minimum-cost-flow resharding: which rows move from old shards to new ones so that row counts are even and the fewest bytes move.

The rows of each old shard are counted in blocks by size class. A flow network leads from the blocks to the new shards: staying costs
nothing, moving costs the block's mean bytes a row, and each new shard takes its capacity, the even share of all rows. The cheapest flow,
by successive shortest paths, says how many rows of each block stay and how many go where; rows are then numbered within their block in
salted parts, and each takes the place that its number falls in. Only the counts of blocks, at most old shards x 256, reach the driver.

Nulls: a null text has no bytes; a null doc_id is a row like others. Equal or repeated rows are separate rows. Ties in a block go by
doc_id, then the text's crc32. An empty table gives an empty result. The law is `rows`: the new shards' counts are at most one apart.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.shared import map_rows, ranked, shared_dir, stored

OVERHEAD = 16
#: Bytes of text that a task which writes takes in the mean; it writes a file of each shard.
PART_BYTES = 256 << 20


def cheapest_flow(supply: list[int], cost: list[float], home: list[int], capacity: list[int]) -> list[dict[int, int]]:
    """For each block, how many of its rows go to each shard; the sum of moved rows' costs is least.

    Block b has supply[b] rows, is at home in shard home[b] (-1: in none that stays), and moves at cost[b] a row. A move costs the same to
    any shard, so all moves pass one hub: arcs block-home (cost 0), block-hub (cost[b]), hub-shard (cost 0). Successive shortest paths
    with potentials; the flow through the hub is then dealt to the shards that it reached.
    """
    blocks, shards = len(supply), len(capacity)
    source, hub, sink = blocks + shards, blocks + shards + 1, blocks + shards + 2
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []
    price: list[float] = []

    def arc(a: int, b: int, most: int, each: float) -> int:
        for x, y, r, c in ((a, b, most, each), (b, a, 0, -each)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)
        return len(to) - 2

    stays, moves = [], []
    for b in range(blocks):
        arc(source, b, supply[b], 0.0)
        stays.append(arc(b, blocks + home[b], supply[b], 0.0) if home[b] >= 0 else -1)
        moves.append(arc(b, hub, supply[b], cost[b]))
    reached = [arc(hub, blocks + s, capacity[s], 0.0) for s in range(shards)]
    for s in range(shards):
        arc(blocks + s, sink, capacity[s], 0.0)
    potential = [0.0] * (sink + 1)
    while True:
        far = [float("inf")] * (sink + 1)
        by = [-1] * (sink + 1)
        far[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x] + 1e-12:
                continue
            for e in graph[x]:
                if room[e] > 0:
                    y = to[e]
                    nd = d + max(0.0, price[e] + potential[x] - potential[y])
                    if nd < far[y] - 1e-9:
                        far[y], by[y] = nd, e
                        heapq.heappush(heap, (nd, y))
        if by[sink] < 0:
            break
        top = max(f for f in far if f < float("inf"))
        potential = [p + min(f, top) for p, f in zip(potential, far)]
        most, x = None, sink
        while x != source:
            most = room[by[x]] if most is None else min(most, room[by[x]])
            x = to[by[x] ^ 1]
        x = sink
        while x != source:
            room[by[x]] -= most
            room[by[x] ^ 1] += most
            x = to[by[x] ^ 1]
    open_ = [[s, room[reached[s] ^ 1]] for s in range(shards) if room[reached[s] ^ 1]]
    out = []
    for b in range(blocks):
        own = {home[b]: room[stays[b] ^ 1]} if stays[b] >= 0 and room[stays[b] ^ 1] else {}
        left = room[moves[b] ^ 1]
        while left:
            n = min(left, open_[0][1])
            own[open_[0][0]] = own.get(open_[0][0], 0) + n
            left -= n
            open_[0][1] -= n
            if not open_[0][1]:
                open_.pop(0)
        out.append(own)
    return out


def plan(blocks: list[tuple[int, int, int, int]], shards: int) -> tuple[list[dict[int, int]], list[int]]:
    """blocks: (old shard, class, rows, bytes). The flow, and the capacities: even shares, the larger ones where most rows already are."""
    rows = sum(b[2] for b in blocks)
    had = [0] * shards
    for old, _, n, _ in blocks:
        if 0 <= old < shards:
            had[old] += n
    capacity = [rows // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-had[s], s))[: rows % shards]:
        capacity[s] += 1
    return cheapest_flow([b[2] for b in blocks], [b[3] / b[2] for b in blocks], [b[0] if 0 <= b[0] < shards else -1 for b in blocks], capacity), capacity


def reshard(rows: DataFrame, shards: int, old: str = "old_shard", size: str = "size") -> DataFrame:
    """rows (doc_id, size, text_crc32, old_shard) with `shard` and `slot`, gapless from 0 in each shard. old_shard may be outside 0..shards-1: such shards are dissolved. A key _row (a string) is handed on."""
    key = [k for k in ("_row",) if k in rows.columns]
    kept = stored(rows.withColumn("_class", F.least(F.lit(255), F.floor(F.log2(F.col(size)) * 6)).cast("int")), "sized")
    blocks = sorted(tuple(r) for r in kept.groupBy(old, "_class").agg(F.count(F.lit(1)), F.sum(size)).collect())
    flow, _ = plan(blocks, shards)
    total = sum(b[2] for b in blocks)
    place = {(b[0], b[1]): (np.cumsum([0, *own.values()]), np.array(list(own), np.int64)) for b, own in zip(blocks, flow)}
    salt = key or ["doc_id", "text_crc32"]  # the row's own key, as any number of rows may have no id and equal texts
    numbered = ranked(kept, [old, "_class"], salt, ["doc_id", "text_crc32", *key], total)

    def assign(cols: dict[str, list]) -> dict[str, object]:
        shard = [int(place[o, c][1][np.searchsorted(place[o, c][0], r, side="right") - 1]) for o, c, r in zip(cols[old], cols["_class"], cols["rank"])]
        return {n: cols[n] for n in ("doc_id", size, "text_crc32", old, *key)} | {"shard": shard}

    given = map_rows(numbered, f"doc_id long, {size} long, text_crc32 long, {old} int, " + "".join(f"{k} string, " for k in key) + "shard int", assign)
    return ranked(given, ["shard"], salt, ["doc_id", "text_crc32", *key], total, "slot")


def sized(docs: DataFrame, old_shards: int) -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), text_crc32, and the old shard: where a hash of the id put the row. A null id's hash is that of its text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(*[k for k in ("_row",) if k in docs.columns], "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.crc32(text))), F.lit(old_shards)).cast("int").alias("old_shard"))


def _equals(df: DataFrame) -> DataFrame:
    """df with _nth: the number of a row among those of equal doc_id, size and text_crc32, which may change places."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy(F.lit(0))))


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """Writes under path/shard=N, with slot and old_shard, the documents of every shard that takes or loses rows, and removes what lies under
    path for a touched shard that is left without rows; other shards stay. Returns the touched shards.

    Rows are joined by the key _row where both tables have it, as sized() and reshard() hand it on; else by doc_id, size and text_crc32, and
    equal ones by their number. So null and repeated ids are written once each."""
    spark = docs.sparkSession
    moved = placed.filter(F.col("shard") != F.col("old_shard"))
    touched = stored(moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct(), "touched")
    own = docs.drop("shard", "slot", "old_shard")
    if "_row" in docs.columns and "_row" in placed.columns:
        given = placed.join(F.broadcast(touched), "shard", "left_semi").select("_row", "size", "shard", "slot", "old_shard")
        parts = max(spark.sparkContext.defaultParallelism, (given.agg(F.sum("size")).first()[0] or 0) // PART_BYTES)
        # dealt by the row's key once, and written from there: the texts are shuffled once
        rows = own.repartition(parts, "_row").join(given.drop("size").repartition(parts, "_row"), "_row").drop("_row")
    else:
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        keys = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + F.lit(OVERHEAD)).cast("long"), "text_crc32": F.crc32(text)}
        left = _equals(docs.select(F.struct(*own.columns).alias("_doc"), *[v.alias(k) for k, v in keys.items()])).alias("a")
        right = _equals(placed).join(F.broadcast(touched), "shard", "left_semi").alias("b")
        rows = left.join(right, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_nth")]).select("_doc.*", "shard", "slot", "old_shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in touched.join(F.broadcast(placed.select("shard").distinct()), "shard", "left_anti").collect():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"shard={r['shard']}"), True)
    return touched


def resharded(docs: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """docs, with a key _row, resharded and the touched shards written in the shared folder: doc_id, size, text_crc32, old_shard, shard, slot; of
    written rows as read back from the files, of rows in other shards as planned."""
    placed = stored(reshard(sized(docs, old_shards), shards), "placed")
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/tables/shards-{uuid.uuid4().hex}"
    touched = rewrite(docs.select("_row", "doc_id", *[c for c in docs.columns if c not in ("_row", "doc_id")]), placed, path)
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    still = placed.join(F.broadcast(touched), "shard", "left_anti").select(*names)
    if touched.isEmpty():
        return still
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    back = docs.sparkSession.read.parquet(path)
    return back.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "old_shard", F.col("shard").cast("int").alias("shard"), "slot").unionByName(still)
