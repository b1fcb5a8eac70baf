"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Method: documents with equal texts form one group, which stays together.
Groups are packed in order of size, each into the bin with the tightest
remaining capacity that still takes it, found in a balanced tree of bins.

Packing every group in one place would not scale, so it runs on two levels
with the same packer:

1. Groups under ``unit`` bytes (total / shards / ``FINENESS``) are packed by
   each task into bundles of ``unit`` bytes.  All bundles of a task but one
   are at least half full.
2. Bundles and larger groups are packed into shards on the driver.  There are
   at most ``2 * shards * FINENESS`` of them plus one for each task, whatever
   the number of documents, and that bound is checked.

With a fixed number of shards the capacity is an equal part of the total.  A
group above the capacity gets a shard alone and the capacity is worked out
anew for the others; what fits nowhere goes to the emptiest shard, so shards
differ by less than one bundle unless a single group is larger.  With a fixed
capacity, as few shards as best fit finds are opened.

Every row then gets a gapless slot in its shard: rows are dealt to cells of
about ``CELL_ROWS`` rows by the hash of the doc_id, cells are counted, and a
row's slot is its cell's offset plus its rank in the cell.  A group of any
number of copies is spread over many cells.

Defined cases
-------------
* null text: size 8, checksum 0; all null texts are one group, apart from
  that of empty texts;
* repeated rows: each row has its own slot, ties are broken by a row number
  inside the cell; null doc_ids come first;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start, stored

#: Bundles per shard: shards of equal bytes differ by at most 1 / FINENESS.
FINENESS = 500
CELL_ROWS = 50_000
#: Bytes that each row takes besides its text.
ROW_BYTES = 8
#: A group is hot above this part of all rows, so fewer than HOT_PART groups are; cells hold no more either.
HOT_PART = 1_000


class _Bin:
    __slots__ = ("room", "number", "weight", "left", "right")

    def __init__(self, room: int, number: int, weight: float):
        self.room, self.number, self.weight = room, number, weight
        self.left = self.right = None


class Tree:
    """Bins by remaining room in a treap: balanced by random weights."""

    def __init__(self, seed: int = 7):
        self.root, self.random = None, random.Random(seed)

    def add(self, room: int, number: int) -> None:
        new = _Bin(room, number, self.random.random())
        key, path, node = (room, number), [], self.root
        while node is not None and node.weight < new.weight:
            right = key > (node.room, node.number)
            path.append((node, right))
            node = node.right if right else node.left
        new.left, new.right = self._split(node, key)
        self._hang(path, new)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with room for ``size``."""
        path, best, node = [], None, self.root
        while node is not None:
            if node.room >= size:
                best = (len(path), node)
                path.append((node, False))
                node = node.left
            else:
                path.append((node, True))
                node = node.right
        return self._remove(path, best)

    def emptiest(self) -> tuple[int, int]:
        path, node = [], self.root
        while node.right is not None:
            path.append((node, True))
            node = node.right
        return self._remove(path, (len(path), node))

    def _remove(self, path, best) -> tuple[int, int] | None:
        if best is None:
            return None
        depth, node = best
        self._hang(path[:depth], self._merge(node.left, node.right))
        return node.room, node.number

    def _hang(self, path, node) -> None:
        if not path:
            self.root = node
        elif path[-1][1]:
            path[-1][0].right = node
        else:
            path[-1][0].left = node

    @staticmethod
    def _split(node, key):
        """Subtrees below and above ``key``."""
        low_root = high_root = low = high = None
        while node is not None:
            if (node.room, node.number) < key:
                if low is None:
                    low_root = node
                else:
                    low.right = node
                low, node = node, node.right
            else:
                if high is None:
                    high_root = node
                else:
                    high.left = node
                high, node = node, node.left
        if low is not None:
            low.right = None
        if high is not None:
            high.left = None
        return low_root, high_root

    @staticmethod
    def _merge(low, high):
        """One tree from two, every key of ``low`` below those of ``high``."""
        root, parent, on_right = None, None, False
        while low is not None and high is not None:
            if low.weight < high.weight:
                top, right = low, True
            else:
                top, right = high, False
            if parent is None:
                root = top
            elif on_right:
                parent.right = top
            else:
                parent.left = top
            parent, on_right = top, right
            if right:
                low = low.right
            else:
                high = high.left
        rest = low if low is not None else high
        if parent is None:
            return rest
        if on_right:
            parent.right = rest
        else:
            parent.left = rest
        return root


def best_fit(sizes: list[int], capacity: int, bins: int | None = None) -> list[int]:
    """Bin of each size; ``sizes`` must fall.

    Without ``bins`` a new bin is opened when none has room.  With ``bins``,
    that many exist, and what fits nowhere goes to the emptiest.
    """
    tree, opened, out = Tree(), 0, []
    for number in range(bins or 0):
        tree.add(capacity, number)
    for size in sizes:
        found = tree.take(size)
        if found is None and bins:
            found = tree.emptiest()
        elif found is None:
            found, opened = (capacity, opened), opened + 1
        room, number = found
        out.append(number)
        tree.add(room - size, number)
    return out


def pack(sizes: list[int], shards: int | None, capacity: int | None) -> list[int]:
    """Shard of each size; ``sizes`` must fall."""
    if not shards:
        return best_fit(sizes, capacity)
    left, alone = sum(sizes), 0
    # A size above an equal part of what is left has a shard for itself.
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest = best_fit(sizes[alone:], -(-left // (shards - alone)), shards - alone)
    return [*range(alone), *(alone + number for number in rest)]


def assign(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row for each document."""
    if not shards and not capacity:
        raise ValueError("a number of shards or a capacity is needed")
    spark = start(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    # Texts themselves go no further than this narrow scan.
    rows = stored(spread_scan(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"), F.col("text").isNull().alias("g0"),
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("deal")))
    group = ["g0", "g1", "g2"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    unit = max(1, (total // shards if shards else capacity) // FINENESS)

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if not own:
            return
        f = pd.concat(own, ignore_index=True).sort_values(["bytes", *group], ascending=False, ignore_index=True)
        small = (f["bytes"] < unit).to_numpy()
        part = TaskContext.get().partitionId() << 40
        number = best_fit(f.loc[small, "bytes"].tolist(), unit)
        large = range(len(number), len(f))  # sizes fall, so the larger ones come first
        f["bundle"] = [part + i for i in large] + [part + i for i in number]
        yield f[[*group, "bytes", "n", "bundle"]]

    bundled = stored(groups.mapInPandas(bundle, "g0 boolean, g1 long, g2 long, bytes long, n long, bundle long"))
    tasks = bundled.rdd.getNumPartitions()
    packed = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy(
        F.desc("bytes"), "bundle")
    most = 3 * (shards or 1 + 2 * (total // max(1, capacity or 1))) * (FINENESS + 1) + tasks
    found = packed.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} bundles")
    shard = pack([r.bytes for r in found], shards, capacity)
    in_cell = max(1, min(CELL_ROWS, count // HOT_PART))
    places = spark.createDataFrame([(r.bundle, s, -(-r.n // in_cell)) for r, s in zip(found, shard, strict=True)],
                                   "bundle long, shard int, cells long")
    placed = bundled.join(F.broadcast(places), "bundle").select(*group, "n", "bundle", "shard", "cells")

    # A hot group's rows would meet in one task of the join: they carry a salt, and its row is there once for each.
    hot = placed.where(F.col("n") > max(1, count // HOT_PART)).select(
        *group, F.ceil(F.col("n") * HOT_PART / F.lit(float(count))).cast("long").alias("salts"))
    dealt = rows.join(F.broadcast(hot), group, "left").withColumn(
        "salt", F.col("deal") % F.coalesce("salts", F.lit(1))).drop("salts")
    salted = placed.join(F.broadcast(hot), group, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "n")
    sharded = stored(dealt.join(salted, [*group, "salt"]).select(
        "doc_id", "size", "text_crc32", "shard", "bundle", "g1", (F.col("deal") % F.col("cells")).alias("cell")))
    cells = sharded.groupBy("shard", "bundle", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bundle", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "bundle", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bundle", "cell").orderBy("g1", "doc_id"))
    ranked = sharded.select("doc_id", "size", "text_crc32", "shard", "bundle", "cell", (rank - 1).alias("rank"))
    return ranked.join(offsets, ["shard", "bundle", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).alias("slot"))
