"""Texts in packs of fixed capacity by sum-of-squares online packing (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = pa.schema([("pack_name", pa.string()), ("pack_id", pa.string()), ("item_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("size", pa.int64())])


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pack of each item, in the order given; sizes are between 1 and capacity.

    count[h] is the number of open packs filled to h. An item goes to the level that makes the sum of the squares of
    count least, a new pack being level 0; of equal levels to the fullest. Full packs leave the array.
    """
    none = -(1 << 29)
    count = np.zeros(capacity + 1, np.int32)
    taken = np.full(capacity + 1, none, np.int32)  # count, but very small where no pack is open
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    pack = np.empty(len(sizes), np.int64)
    packs = 0
    cost = np.empty(capacity + 1, np.int32)
    for i, s in enumerate(sizes.tolist()):
        room = capacity - s
        # change of the sum of squares: 1 - 2 count[room] where the item closes a pack, 2 count[s] + 1 for a new one,
        # 2 (count[h + s] - count[h]) + 2 between; of equal changes the fullest level comes first
        h, best = 0, (2 * int(count[s]) + 1 if room else 0)
        if room > 1:
            c = np.subtract(count[s + 1 : capacity], taken[1:room], out=cost[: room - 1])
            at = room - 1 - int(c[::-1].argmin())
            change = 2 * int(c[at - 1]) + 2
            if change <= best:
                h, best = at, change
        if room and count[room] and 1 - 2 * int(count[room]) <= best:
            h = room
        if h == 0:
            at, packs = packs, packs + 1
        else:
            at = opened[h].pop()
            count[h] -= 1
            taken[h] = count[h] or none
        if h + s < capacity:
            count[h + s] += 1
            taken[h + s] = count[h + s]
            opened[h + s].append(at)
        pack[i] = at
    return pack


def merge_open(pack: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Packs joined where two that stayed open fit into one, the fullest first, each into the tightest room."""
    fill = np.bincount(pack, weights=sizes).astype(np.int64) if len(pack) else np.zeros(0, np.int64)
    target = np.arange(len(fill))
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, bool)
    for p in np.argsort(-fill, kind="stable").tolist():
        f = int(fill[p])
        at = np.flatnonzero(free[f:])[:1]
        if f < capacity and len(at):
            r = f + int(at[0])
            q = rooms[r].pop()
            free[r] = bool(rooms[r])
            target[p], left = q, r - f
        else:
            q, left = p, capacity - f
        if left:
            rooms[left].append(q)
            free[left] = True
    return target[pack]


def pack_items(items: DataFrame, packs: DataFrame, block_items: int = 50_000) -> DataFrame:
    """pack_name, pack_id, item_id, part, start, size: every item of items (item_id, size BIGINT) in a pack of each kind.

    packs: pack_name, capacity (a small fixed table, at most a few hundred rows: it is gathered into one value). An
    item larger than the capacity is cut into parts of the capacity and a rest (part from 1, start in tokens); no
    other is split. Items of size 0 or null take no room and are in no pack; so are kinds of null or non-positive
    capacity. Items are spread by hash over blocks of about block_items, each packed by itself in an order that a hash
    of the id fixes; only ids and sizes are shuffled. Packs left open are joined within the block where two fit into one.
    """
    kinds = packs.filter("capacity > 0 AND pack_name IS NOT NULL").agg(F.collect_list(F.struct("pack_name", F.col("capacity").cast("bigint").alias("capacity")))).scalar()
    some = items.filter("size > 0")
    blocks = F.greatest(F.lit(1), F.ceil(some.agg(F.count("*")).scalar() / block_items)).cast("bigint")
    rows = some.withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(8)), blocks)).select("item_id", "size", "block", F.explode(kinds).alias("k")).select("item_id", "size", "block", "k.*")

    def one_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        name, block = (k.as_py() for k in key)
        cap = int(t["capacity"][0].as_py())
        ids, total = t["item_id"].to_numpy(), t["size"].to_numpy()
        mix = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # arrival order: as good as random, the same in every run
        mix ^= mix >> np.uint64(29)
        parts = -(-total // cap)
        row = np.repeat(np.arange(len(ids)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * cap
        size = np.minimum(total[row] - start, cap)
        order = np.lexsort((part, ids[row], mix[row]))
        row, part, start, size = row[order], part[order], start[order], size[order]
        at = merge_open(sum_of_squares(size, cap), size, cap)
        yield pa.record_batch([pa.array([name] * len(row), pa.string()), pa.array([f"{name}-{block}-{p}" for p in at.tolist()], pa.string()), pa.array(ids[row], pa.int64()), pa.array(part + 1, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], schema=_OUT)

    return rows.groupBy("pack_name", "block").applyInArrow(one_block, "pack_name string, pack_id string, item_id bigint, part int, start bigint, size bigint")


def fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity, packs, tokens, fill: the share of the packs' room that is used."""
    by_pack = packed.groupBy("pack_name").agg(F.countDistinct("pack_id").alias("packs"), F.sum("size").alias("tokens"))
    return by_pack.join(packs.select("pack_name", F.col("capacity").cast("bigint").alias("capacity")), "pack_name").withColumn("fill", F.col("tokens") / (F.col("packs") * F.col("capacity")))
