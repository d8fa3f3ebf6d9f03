"""Near-duplicates by SimHash, found through Golay codes.

The 64 bits of a fingerprint are three segments. Two fingerprints that differ in at most three bits either agree in one
segment and differ in at most one bit in another, or differ in exactly one bit in each (pigeonhole). Segments are decoded to
the indices of nearby codewords, so a segment with one error still meets in a key: (an exact segment, a decoded one) for
the first case, three decoded ones for the second. Keys have 34 to 36 bits, so a key stays selective in a large corpus.
Pairs that meet in a key are verified; distinct fingerprints, not documents, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import body, written
from .components import components

WORDS = 3
SEED = 42
DISTANCE = 3
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, unsigned: a bit is set if more than half of the shingles' hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, the six white-space characters only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(WORDS)])) if len(words) >= WORDS else iter([b" ".join(words)])
    n = max(1, len(words) - WORDS + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        ones += np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n))


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """As signed numbers with the same bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 7) keys under which fingerprints lie, and (n, 6 * 6 + 216) keys under which they are looked for; -1 fills up."""
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append((prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    own = [golay.decode(p) for p in parts]
    near = [golay.nearby(p, b) for p, b in zip(parts, SEGMENTS)]
    lie, look = [], []
    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        tag = (np.int64(kind) << 36) + (parts[i] << 12)
        lie.append((tag + own[j])[:, None])
        look.append(np.where(near[j] < 0, -1, tag[:, None] + near[j]))
    tag = np.int64(6) << 36
    lie.append((tag + (own[0] << 24) + (own[1] << 12) + own[2])[:, None])
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    look.append(np.where((a < 0) | (b < 0) | (c < 0), -1, tag + (a << 24) + (b << 12) + c).reshape(len(prints), -1))
    return np.concatenate(lie, axis=1), np.concatenate(look, axis=1)


def _keyed(prints: DataFrame, looking: bool) -> DataFrame:
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                own = batch["fp"].to_numpy()[at : at + 2000]
                found = keys(own.view(np.uint64))[looking]
                row, column = np.nonzero(found >= 0)
                yield pd.DataFrame({"key": found[row, column], "fp": own[row]})

    return prints.select("fp").mapInPandas(spread, "key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """a < b: all pairs of the distinct fingerprints of ``prints`` (column fp) that differ in at most three bits."""
    lie, look = _keyed(prints, False).withColumnRenamed("fp", "a"), _keyed(prints, True).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return look.join(lie, "key").where(near).select("a", "b").distinct()


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row: the smallest id reachable over links.

    Whole texts are fingerprinted. Texts without words, null ones too, have fingerprint zero and are linked like any other.
    Rows with equal fingerprints are linked whatever their ids. A null id is never the smallest; a component of null ids
    alone has a null component_id. Empty tables give no rows. Only doc_id and text are read.
    """
    return _components(_marked(docs)).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, digest, fp, root of every row: rows of one root are linked, over any number of links."""
    return _components(_marked(docs)).select("doc_id", "digest", "fp", "root")


def _marked(docs: DataFrame) -> DataFrame:
    text = body(docs)
    return written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("digest"), fingerprints(docs["text"].cast("string")).alias("fp")), "fingerprints")


def _components(marked: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp, ...) with root (the component's smallest fingerprint) and component_id. Copies meet in one sum per fingerprint before anything is joined."""
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(components(links(classes)), "roots").withColumnRenamed("node", "fp")
    rooted = written(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group, with its own columns: the one of the smallest id; among several of that id the one of the
    smallest text hash. A row with a null id stays only if its whole group has null ids. Of rows equal in id and text any
    one stays."""
    first = _components(_marked(docs)).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("chosen_id"), F.col("f.digest").alias("chosen_digest"))
    text = body(docs)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(text, F.octet_length(text)).alias("own_digest"))
    kept = row.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_digest") == F.col("chosen_digest")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_digest"]).select("row.*")
