"""Sharding by Karmarkar-Karp differencing: indivisible groups of equal texts, shards of near-equal bytes.

A partial partition is a vector of shard loads. The two partial partitions of largest spread are
combined again and again, the heaviest slot of one onto the lightest of the other. The work is cut in
two so that no task grows with the input: groups above a fixed share of all bytes (their number has a
bound that follows from the share) are differenced together; the rest is dealt by hash into leaves of
a few thousand groups, and each leaf differences its groups together with the heavy vector, scaled to
the leaf's share of the bytes, so that small groups level what large ones leave uneven.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


def difference(sizes: np.ndarray, k: int, seed: np.ndarray | None = None) -> np.ndarray:
    """Slot (0 to k-1) of each size by k-way differencing; seed: loads that the slots carry already.

    With a seed, slot i is the one that carries seed[i].
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    if k == 1:
        return np.zeros(n, dtype=np.int32)
    loads: list[np.ndarray | None] = []
    left: list[int] = []
    right: list[int] = []
    orders: list[np.ndarray] = []
    heap: list[tuple[float, int]] = []
    for i, s in enumerate(sizes):
        v = np.zeros(k, dtype=np.float64)
        v[0] = s
        loads.append(v)
        heap.append((-float(s), i))
    seeded = n if seed is not None else -1
    if seed is not None:
        rank = np.argsort(-seed, kind="stable")
        v = seed[rank].astype(np.float64)
        loads.append(v)
        heap.append((-(v[0] - v[-1]), n))
    leaves = len(loads)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        v = both[order]
        loads[a] = loads[b] = None
        left.append(a)
        right.append(b)
        orders.append(order)
        loads.append(v)
        heapq.heappush(heap, (v[-1] - v[0], len(loads) - 1))
    slots = np.empty(leaves, dtype=np.int32)
    seed_map = None
    stack = [(len(loads) - 1, np.arange(k, dtype=np.int32))]
    while stack:
        node, at = stack.pop()
        if node < leaves:
            slots[node] = at[0]
            if node == seeded:
                seed_map = at
            continue
        order = orders[node - leaves]
        first = np.empty(k, dtype=np.int32)
        first[order] = at
        stack.append((left[node - leaves], first))
        stack.append((right[node - leaves], first[::-1]))
    if seed_map is not None:
        name = np.empty(k, dtype=np.int32)
        name[seed_map] = rank
        slots = name[slots]
    return slots[:n]


def _differenced(k: int, heavy: list[float] | None, total: float):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "gkey"], ascending=[False, True], kind="stable")
        sizes = groups["bytes"].to_numpy(dtype=np.float64)
        seed = np.array(heavy) * (sizes.sum() / total) if heavy is not None else None
        return pd.DataFrame({"gkey": groups["gkey"].to_numpy(), "bytes": groups["bytes"].to_numpy(), "shard": difference(sizes, k, seed)})

    return run


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", heavy_share: int = 500, leaf_groups: int = 4000, slot_rows: int = 20_000) -> DataFrame:
    """Deal every row into one of `shards` shards: doc_id, size, text_crc32, shard, slot.

    Rows of equal text form one indivisible group and share a shard; a null text counts as empty. A
    group larger than a shard's share fills a shard of its own as far as it goes. Repeated rows and
    null identifiers are rows like any other. Slots number a shard's rows without gaps. An empty
    table gives an empty result. Only id_col and text_col are read.

    heavy_share bounds the task that differences large groups: at most shards * heavy_share of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("gkey"),
        ),
        "kk-rows",
    )
    groups = staged(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")), "kk-groups")
    limit = F.col("bytes") * shards * heavy_share > F.lit(groups.agg(F.sum("bytes")).first()[0] or 0)
    light_n, light_bytes, n = groups.agg(F.count_if(~limit), F.sum(F.when(~limit, F.col("bytes"))), F.count("*")).first()
    out = "gkey binary, bytes long, shard int"
    heavy = staged(groups.where(limit).groupBy(F.lit("all").alias("one")).applyInPandas(_differenced(shards, None, 0.0), out), "kk-heavy")
    loads = [0.0] * shards
    for r in heavy.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():  # at most `shards` rows
        loads[r["shard"]] = float(r["b"])
    leaves = max(1, -(-light_n // leaf_groups))
    light = (
        groups.where(~limit)
        .withColumn("leaf", F.pmod(F.xxhash64("gkey"), F.lit(leaves)))
        .groupBy("leaf")
        .applyInPandas(_differenced(shards, loads, float(light_bytes or 1)), out)
    )
    assigned = staged(heavy.unionByName(light), "kk-assigned")
    return slotted(rows.join(assigned.select("gkey", "shard"), "gkey"), n, shards, slot_rows)


def slotted(rows: DataFrame, n: int, shards: int, slot_rows: int) -> DataFrame:
    """Number the rows of each shard from 0: by hashed parts of bounded size and a running sum of their counts."""
    parts = max(1, -(-n // (shards * slot_rows)))
    dealt = staged(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(parts)).cast("int")), "kk-dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = counts.select("shard", "part", (F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "gkey")) - 1
    return dealt.withColumn("own", own).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))


