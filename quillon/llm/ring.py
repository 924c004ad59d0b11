"""Operator 3: sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring of 2^32 places. A key belongs to the
first point clockwise from its own place. No shard takes more than
``capacity = ceil((1 + slack) * keys / shards)``; the keys that overflow a full shard
continue clockwise to the next shard that isn't full. Keys arrive in rounds: first all at
their own shard, then the overflow at its next one, and so on; in each round a shard takes
keys in the order of their priority hash. So the outcome depends on the keys alone, not on
partitioning or arrival, and few keys move when a shard joins or leaves.

Keys find their point in the table of their arc of the ring, which lists the points of the
arc and the next one. The driver sees a row a shard in each round: how many keys asked for it, and in
which 1/4096 of the priorities it became full. The rows of that part are the only ones
that are ranked.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._frames import cut, pick

#: Points whose table is broadcast, some 100 MB; that of a larger ring is joined by shuffle.
BROADCAST_POINTS = 2_000_000
#: Parts that equal keys at a shard's limit are ranked in, so that no task ranks all of them.
SALTS = 1024


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; of points at one place the least shard is first."""
    return sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(virtual_nodes))


def _arcs(spark: SparkSession, points: np.ndarray, closed: set[int], bits: int) -> DataFrame:
    """``arc INT, points ARRAY<STRUCT<place, shard>>``: open points of each of 2^bits arcs and the next one, which is at the end of everything."""
    own = points[~np.isin(points[:, 1], list(closed))]
    arcs = np.arange(1 << bits)
    first = np.searchsorted(own[:, 0], arcs << (32 - bits))
    after = np.searchsorted(own[:, 0], (arcs + 1) << (32 - bits))
    n = after - first + 1
    offsets = np.r_[0, np.cumsum(n)]
    at = np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])
    last = np.zeros(len(at), bool)
    last[offsets[1:] - 1] = True
    place = np.where(last, 1 << 32, own[at % len(own), 0])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(place), pa.array(own[at % len(own), 1].astype(np.int32))], ["place", "shard"]))
    table = spark.createDataFrame(pa.table({"arc": pa.array(arcs.astype(np.int32)), "points": lists}))
    return F.broadcast(table) if len(points) <= BROADCAST_POINTS else table  # a row a point, or two


def assign(df: DataFrame, key_col: str = "doc_id", shards: int = 64, virtual_nodes: int = 128, slack: float = 0.1) -> DataFrame:
    """``doc_id, shard INT, hops INT`` for every row; ``hops`` counts the rounds in which a full shard passed it on.

    Each row counts as one, repeated keys too; equal priorities are ordered by key, and which of several rows
    of one key overflow doesn't matter, for they are alike. A null key hashes like the text ``null``. An empty
    table gives an empty result. Other columns, texts of any length among them, are dropped. A key that
    fills many shards takes a round for each.
    """
    if shards < 1 or virtual_nodes < 1 or slack < 0:
        raise ValueError("shards and virtual nodes must be positive, slack not negative")
    spark = df.sparkSession
    points = np.array(ring_points(shards, virtual_nodes), np.int64)
    bits = min(24, max(1, math.ceil(math.log2(len(points)))))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    waiting = pick(df, doc_id=key_col).select("doc_id", number(1, 8).alias("place"), number(9, 15).alias("priority"))
    capacity = math.ceil((1 + slack) * waiting.count() / shards)
    load, closed, done, hops = dict.fromkeys(range(shards), 0), set(), None, 0
    while True:
        arc = F.shiftright("place", 32 - bits).cast("int")
        placed = waiting.withColumn("arc", arc).join(_arcs(spark, points, closed, bits), "arc")
        placed = placed.withColumn("shard", F.get(F.filter("points", lambda p: p["place"] >= F.col("place")), 0)["shard"])
        placed = placed.select("doc_id", "place", "priority", "shard", F.shiftright("priority", 48).alias("bucket"))
        rooms = F.broadcast(spark.createDataFrame([(s, capacity - load[s]) for s in load], "shard int, room long"))  # a row a shard
        counted = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket"))).join(rooms, "shard")  # 4096 rows a shard
        full = F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", (F.col("room") - F.col("upto") + F.col("n")).alias("room"))))
        limits = []
        for r in counted.groupBy("shard").agg(F.sum("n").alias("asked"), full.alias("full")).collect():  # a row a shard
            load[r["shard"]] += min(capacity - load[r["shard"]], r["asked"])
            if load[r["shard"]] == capacity:
                closed.add(r["shard"])
            if r["full"]:
                limits.append((r["shard"], r["full"]["bucket"], r["full"]["room"]))
        out = ["doc_id", "shard", F.lit(hops).alias("hops")]
        if not limits:
            last = placed.select(*out)
            return last if done is None else done.unionByName(last)
        full = F.broadcast(spark.createDataFrame(limits, "shard int, limit_bucket long, room long"))  # a row a shard at most
        judged = placed.join(full, "shard", "left")
        edge = _ranked(judged.where(F.col("bucket") == F.col("limit_bucket")))
        sure = judged.where(F.col("limit_bucket").isNull() | (F.col("bucket") < F.col("limit_bucket"))).select(*out)
        taken = sure.unionByName(edge.where(F.col("at") <= F.col("room")).select(*out))
        done = taken if done is None else done.unionByName(taken)
        rest = ["doc_id", "place", "priority"]
        waiting = cut(judged.where(F.col("bucket") > F.col("limit_bucket")).select(*rest).unionByName(edge.where(F.col("at") > F.col("room")).select(*rest)))
        hops += 1


def _ranked(edge: DataFrame) -> DataFrame:
    """The rows with ``at``, their place from 1 in the order of priority and key at their shard; equal keys in any order, which is kept in a table."""
    edge = cut(edge.select("doc_id", "place", "priority", "shard", "room", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")))
    key = ["shard", "priority", "doc_id", "salt"]
    sizes = edge.groupBy(*key).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("priority", "doc_id", "salt")) - F.col("n"))
    own = edge.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("place")))
    same = [own[c].eqNullSafe(before[c]) if c == "doc_id" else own[c] == before[c] for c in key]
    return own.join(before, same).select(own["doc_id"], own["place"], own["priority"], own["shard"], "room", (F.col("before") + F.col("k")).alias("at"))
