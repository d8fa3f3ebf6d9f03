"""Packing documents into token sequences: best fit, then a local search that exchanges documents between underfull bins.

Only the lengths of pieces travel, never their ids. Pieces are dealt evenly to blocks of bounded size; each block is packed
on its own and can fall short of the best packing by part of a sequence, so what blocks cost is a fixed small share.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import matched
from .common import joined_id, split_id, written
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Pieces of one block.
BLOCK = 10_000
PIECE = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document's ids, ended by ``end_id`` and cut to ``capacity``: doc_id, piece, start, length, ids_crc32 (and ids)."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, end = encoder(path).encode_all, array("I", [end_id]).tobytes()
        for batch in batches:
            rows = []
            for doc_id, known, ids in zip(batch["doc_id"], batch["known"], encode_all(batch["text"])):
                ids += end
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, known, i, start, length, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype("int32"),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "known", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return joined_id(docs.select(*split_id(docs), docs["text"].cast("string").alias("text")).mapInPandas(cut, PIECE + ", ids array<int>" * with_ids))


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece: best fit in order of falling length, then exchanges until none helps or no bin can be saved."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r free
    for i in order:
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            k, room = len(bins), capacity
            bins.append([])
        bins[k].append(i)
        if room > n:
            open_by_room.setdefault(room - n, []).append(k)
            rooms |= 1 << (room - n)
    _exchange(bins, lengths, capacity)
    bin_of = [0] * len(lengths)
    for k, b in enumerate(b for b in bins if b):
        for i in b:
            bin_of[i] = k
    return bin_of


def _exchange(bins: list[list[int]], lengths: list[int], capacity: int) -> None:
    """Local search. A bin, the least filled first, gives documents to other underfull bins: one moves, or one or two change
    places with a shorter one there. The receiver must end up fuller than the giver was, so the sum of squared fills grows
    with every step and the giver runs empty. Rounds over all underfull bins end when none finds a step, or when no bin
    can be saved any more."""
    least = -(-sum(lengths) // capacity)
    used = len(bins)
    room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)
    # One entry per document, and after them one per bin for "nothing in return".
    at = np.empty(len(lengths) + len(bins), np.int64)
    for k, b in enumerate(bins):
        at[b] = k
    at[len(lengths) :] = np.arange(len(bins))
    back = np.concatenate([np.array(lengths, np.int64), np.zeros(len(bins), np.int64)])
    stepped = True
    while stepped and used > least:
        stepped = False
        for target in sorted(np.flatnonzero(room > 0).tolist(), key=lambda k: (-room[k], k)):
            while bins[target] and used > least:
                step = _step(target, bins[target], lengths, capacity, room, at, back)
                if step is None:
                    break
                offer, e = step
                k, gain = int(at[e]), sum(lengths[i] for i in offer) - int(back[e])
                for i in offer:
                    bins[target].remove(i)
                    bins[k].append(i)
                    at[i] = k
                if e < len(lengths):
                    bins[k].remove(e)
                    bins[target].append(e)
                    at[e] = target
                room[k] -= gain
                room[target] += gain
                stepped = True
            if not bins[target]:
                room[target] = 0  # closed
                used -= 1


def _step(target: int, mine: list[int], lengths: list[int], capacity: int, room: np.ndarray, at: np.ndarray, back: np.ndarray):
    """What ``target`` gives and the entry it gets for it: what fills the other bin best, then what empties it most."""
    open_entries = np.flatnonzero((room[at] > 0) & (at != target))
    if not len(open_entries):
        return None
    free, theirs = room[at[open_entries]], back[open_entries]
    best = None
    for offer in [*((i,) for i in mine), *((i, j) for a, i in enumerate(mine) for j in mine[a + 1 :])]:
        out = sum(lengths[i] for i in offer)
        gain = out - theirs
        left = np.where((gain > 0) & (gain <= free) & (gain - free > -room[target]), free - gain, capacity + 1)
        lowest = int(left.min())
        if lowest > capacity or (best is not None and lowest > best[0]):
            continue
        even = np.flatnonzero(left == lowest)
        e = int(even[np.argmax(gain[even])])
        if best is None or (lowest, -int(gain[e])) < best[:2]:
            best = (lowest, -int(gain[e]), offer, int(open_entries[e]))
    return best and best[2:]


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences: adds sequence_id and offset.

    Offsets are gapless from 0 within a sequence. Repeated pieces are pieces like any other. An empty table gives no rows.
    """
    parts = written(parts.select(*split_id(parts), "piece", "start", "length", "ids_crc32"), "pieces")
    blocks = max(1, -(-parts.count() // block))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [b for b in batches if len(b)]
        if not own:
            return
        rows = pd.concat(own, ignore_index=True)
        rows["sequence_id"] = (np.int64(TaskContext.get().partitionId()) << 32) + np.array(pack_block(rows["length"].tolist(), capacity), np.int64)
        rows = rows.sort_values(["sequence_id", "doc_id", "piece"], kind="stable")
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        yield rows

    return joined_id(parts.repartition(blocks).mapInPandas(place, PIECE + ", sequence_id long, offset long"))  # dealt row by row, so by no key


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece of every whole text of ``docs``, with its place.

    A null or empty text is the end id alone. Longer documents than ``capacity`` are cut, the first piece taking what is
    left over. A null id stays null. Rows equal in id and text are packed each. Only doc_id and text are read.
    """
    return pack(pieces(docs, capacity, end_id, path), capacity)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """sequence_id and its ids in order: the sequences themselves, at most ``capacity`` ids each."""
    at = placed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    cut = pieces(docs, capacity, end_id, path, with_ids=True)
    same = ["doc_id", "piece", "ids_crc32"]
    joined = matched(at, cut.select(*same, "ids").dropDuplicates(same), same)
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
