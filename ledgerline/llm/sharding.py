"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, for good. What moves between shards is a slot, never a record: a
small versioned table says which shard owns which slot, and rebalancing edits that table. The only thing that leaves the
executors is the weight of each slot, ``SLOTS`` numbers at any size of input.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_dir
from .common import body

SLOTS = 4096
#: Bytes a record takes besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each virtual slot, in one version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s * shards // slots for s in range(slots)))

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """The next version: slots move, or change places, between the heaviest and the lightest shard while that evens them out."""
        owner = list(self.owner)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for s, k in enumerate(owner):
            held[k].append((weight[s], s))
        for h in held:
            h.sort()
        load = [sum(w for w, _ in h) for h in held]
        while True:
            top, low = max(range(self.shards), key=lambda k: (load[k], -k)), min(range(self.shards), key=lambda k: (load[k], k))
            found = _exchange(held[top], held[low], load[top] - load[low])
            if found is None:
                return SlotMap(self.version + 1, self.shards, tuple(owner))
            for item, source, target in ((found[0], top, low), (found[1], low, top)):
                if item is not None:
                    held[source].pop(bisect_left(held[source], item))
                    held[target].insert(bisect_left(held[target], item), item)
                    owner[item[1]] = target
                    load[source] -= item[0]
                    load[target] += item[0]

    def grown(self, weight: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots until it holds its part; no slot moves between old shards."""
        owner, new = list(self.owner), self.shards
        load = [0] * self.shards
        for s, k in enumerate(owner):
            load[k] += weight[s]
        part = sum(load) / (new + 1)
        taken = 0
        for s in sorted(range(len(owner)), key=lambda s: (-weight[s], s)):
            if load[owner[s]] - weight[s] >= part - weight[s] / 2 and taken + weight[s] <= part:
                load[owner[s]] -= weight[s]
                taken += weight[s]
                owner[s] = new
        return SlotMap(self.version + 1, new + 1, tuple(owner))


def _exchange(top: list[tuple[int, int]], low: list[tuple[int, int]], gap: int):
    """The slot to move down, and one to move up in return or None, that leaves the two shards most even; None if nothing helps."""
    best, found = gap, None
    for item in top:
        at = bisect_left(low, (item[0] - gap / 2, -1))
        for back in (None, *low[max(0, at - 1) : at + 1]):
            left = abs(gap - 2 * (item[0] - (back[0] if back else 0)))
            if left < best:
                best, found = left, (item, back)
    return found


def slot_column(*key: Column) -> Column:
    """The virtual slot of a record: fixed by its key and by nothing else."""
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def save(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    rows = [(slots.version, slots.shards, s, k) for s, k in enumerate(slots.owner)]
    spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default."""
    rows = spark.read.parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    kept = rows.where(F.col("version") == version).orderBy("virtual_slot").collect()  # SLOTS rows
    return SlotMap(version, kept[0]["shards"], tuple(r["shard"] for r in kept))


def slot_weights(measured: DataFrame) -> tuple[list[int], list[int]]:
    """Bytes and rows of every virtual slot: at most ``SLOTS`` rows reach the driver."""
    weight, count = [0] * SLOTS, [0] * SLOTS
    for r in measured.groupBy("virtual_slot").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
        weight[r["virtual_slot"]], count[r["virtual_slot"]] = r["w"], r["n"]
    return weight, count


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row.

    The slot follows from id and text, so that rows which share an id (or a text) but not both are spread over slots.
    """
    text = body(docs)
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_column(docs["doc_id"], text).alias("virtual_slot"),
    )


def shard(docs: DataFrame, shards: int = 24, path: str | None = None) -> DataFrame:
    """Deal documents to shards of nearly equal bytes.

    ``path`` keeps the versions of the slot map; the first call stores version 1 (slots in equal runs) and the rebalanced
    version 2, a later call edits the latest version. Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8),
    text_crc32, shard, slot (the row's place in its shard, gapless from 0, by virtual slot, id and checksum),
    virtual_slot, map_version.

    An empty table gives no rows. Null and empty texts weigh 8 bytes with checksum 0; a null id is a key like any other.
    Rows equal in id and text share a virtual slot and lie side by side. Other columns are not looked at.
    """
    spark = docs.sparkSession
    measured = measure(docs)
    weight, count = slot_weights(measured)
    path = path or fresh_dir(spark, "slot-map")
    try:
        now = load(spark, path)
    except Exception as missing:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        now = SlotMap.first(shards)
        save(spark, now, path)
    if now.shards != shards:
        raise ValueError(f"the stored map has {now.shards} shards; grow it first")
    now = now.rebalanced(weight)
    save(spark, now, path)
    before, filled = [], [0] * shards
    for s, k in enumerate(now.owner):
        before.append(filled[k])
        filled[k] += count[s]
    owners = spark.createDataFrame(
        [(s, k, b) for s, (k, b) in enumerate(zip(now.owner, before))], "virtual_slot int, shard int, before long"
    )
    # A window per virtual slot, not per shard: thousands of small groups, and the map says how many rows lie before each.
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        measured.withColumn("place", place)
        .join(F.broadcast(owners), "virtual_slot")  # SLOTS rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "virtual_slot", F.lit(now.version).alias("map_version"))
    )
