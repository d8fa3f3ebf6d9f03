"""Near copies by the words they share: Jaccard similarity of the sets of five-word shingles, found through MinHash bands.

A band is the hash of eight minima; texts that agree in a band are candidates, and every link is confirmed on the whole sets.
Two sets of similarity s agree in a band with probability s ** ROWS. Of ``BANDS`` bands, half are made of minima in turn and
half of the same minima across, so two bands share one minimum at most; a pair of similarity 0.8 meets in no band with
probability (1 - 0.8 ** 8) ** 24 = 0.012, one of 0.9 in 2 of a million cases.

Texts with equal sets are one node. No pairs are formed within a band. In the first round all members are compared with the
smallest one; links join components. From then on each band that still holds several components names pivots: ``PIVOTS``
nodes of the largest, and one node each of ``PIVOTS`` others, drawn by hashes that change with the round. Members are
compared with the pivots of components as large as their own or larger, so a round takes 2 x ``PIVOTS`` comparisons per
member at most, and next to none for the members of a large component. Rounds end when one adds no link. Then all pairs that
still meet in a band but lie in different components, and are not too unequal in size, are compared, so no pair that meets in
a band is left out. Pairs that are no links remain in that step, and in a band of many components they grow with the square of
its size. What is missed are pairs that meet in no band; tests hold the recall against all pairs, and the README states it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import body, written
from .components import components

WORDS = 5
#: Percent of the shingles of either that both have.
SIMILAR_PERCENT = 80
BANDS, ROWS, MINIMA = 24, 8, 96
#: Nodes of a band's largest component, and others, that its members are compared with in a round.
PIVOTS = 1
SEED = 42
#: Shingles hashed at once.
AT_ONCE = 1 << 9

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words, lower-cased A-Z; the whole of a shorter text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(WORDS)])) if len(words) >= WORDS else iter([b" ".join(words)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, max(1, len(words) - WORDS + 1)))


def bands(own: np.ndarray) -> np.ndarray:
    """The 64-bit keys of the bands of a set that is not empty."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), AT_ONCE):
        part = own[at : at + AT_ONCE]
        mixed = (part ^ _SHIFTS[:, None]) * _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _FACTORS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = np.concatenate([least.reshape(-1, ROWS), least.reshape(ROWS, -1).T])
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)


def _sketch(texts: pd.Series) -> pd.DataFrame:
    nodes, keys = [], []
    for t in texts:
        own = shingles(t)
        nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
        keys.append(bands(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
    return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "bands": keys})


#: Told to be nondeterministic, so that no text is sketched twice.
sketched = F.pandas_udf(_sketch, T.StructType([T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])).asNondeterministic()


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def _digest(docs: DataFrame) -> Column:
    text = body(docs)
    return F.xxhash64(text, F.octet_length(text))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows a, b of ``pairs`` whose sets (``sets``: node, shingles) are similar enough; sets of too unequal size are not compared."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    least, most, total = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb")), F.size("sa") + F.size("sb")
    shared = F.when(least * 100 >= most * SIMILAR_PERCENT, F.size(F.array_intersect("sa", "sb"))).otherwise(0)
    return both.where(shared * (100 + SIMILAR_PERCENT) >= total * SIMILAR_PERCENT).select("a", "b")


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, digest, node, root of every row: rows of one root are near copies of each other, over any number of links."""
    marked = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), _digest(docs).alias("digest"), sketched(docs["text"].cast("string")).alias("s")).select("doc_id", "digest", "s.*"), "near-sketches")
    keyed = marked.select("node", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("z")).where("least != z").select("key", "least")
    members = written(keyed.join(shared, "key"), "near-bands")
    wanted = members.select("node").distinct()
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f")
    one = marked.groupBy("node").agg(row).join(wanted, "node", "left_semi").select("node", F.col("f.doc_id").alias("one_id"), F.col("f.digest").alias("one_digest"))
    texts = docs.select(docs["doc_id"].cast("long").alias("own_id"), _digest(docs).alias("own_digest"), docs["text"].cast("string").alias("text"))
    texts = texts.join(one, F.col("own_id").eqNullSafe(F.col("one_id")) & (F.col("own_digest") == F.col("one_digest"))).dropDuplicates(["node"])
    sets = written(texts.select("node", shingle_sets("text").alias("shingles")), "near-sets")
    stars = members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(stars, sets)
    roots, turn, apart = None, 0, False
    while True:
        new = written(links, "near-links")
        if turn and new.isEmpty():
            if apart:
                break
            apart = True
            links = confirmed(_left_apart(members, roots, sets), sets)
            continue
        known = new if roots is None else new.unionByName(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
        roots = written(components(known), "near-roots")
        if apart:
            break
        turn += 1
        links = confirmed(_with_pivots(members, roots, turn), sets)
    return marked.select("doc_id", "digest", "node").join(roots, "node", "left").select("doc_id", "digest", "node", F.coalesce("root", "node").alias("root"))


def _left_apart(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a < b of all nodes that meet in a band, lie in different components and may be similar enough by their sizes."""
    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    sized = written(placed.join(several, "key").join(sets.select("node", F.size("shingles").alias("size")), "node"), "near-apart")
    one, other = sized.toDF("node_a", "key", "root_a", "size_a"), sized.toDF("node_b", "key", "root_b", "size_b")
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    near = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (least * 100 >= most * SIMILAR_PERCENT)
    return one.join(other, "key").where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _with_pivots(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs a < b of a member of a band and a pivot of another component there; minima of hashes choose pivots, so no band is sorted."""
    placed = written(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-placed")
    drawn = lambda by, k, *more: F.min(F.struct(F.xxhash64(by, F.lit(turn), F.lit(k)).alias("h"), *more))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), *[drawn("node", k, "node")["node"].alias(f"n{k}") for k in range(PIVOTS)])
    largest = F.max(F.struct("size", "root", *[f"n{k}" for k in range(PIVOTS)])).alias("large")
    bands = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), largest, *[drawn("root", k, "size", "root", "n0").alias(f"o{k}") for k in range(PIVOTS)]).where("n > 1")
    pivot = lambda of, node: F.struct(F.col(f"{of}.size").alias("size"), F.col(f"{of}.root").alias("root"), F.col(f"{of}.{node}").alias("node"))
    pivots = bands.select("key", F.array_distinct(F.array(*[pivot("large", f"n{k}") for k in range(PIVOTS)], *[pivot(f"o{k}", "n0") for k in range(PIVOTS)])).alias("pivots"))
    asked = parts.join(pivots, "key").select("key", "root", F.filter("pivots", lambda p: (p["root"] != F.col("root")) & (p["size"] >= F.col("size"))).alias("pivots"))
    met = placed.join(asked.where(F.size("pivots") > 0), ["key", "root"]).select("node", F.explode("pivots.node").alias("p"))
    return met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _with_fingerprints(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the roots that follow if texts whose fingerprints ``simhash`` links are near copies, too."""
    roots = rows.select("digest", "root").distinct()
    met = roots.join(simhash.rooted(docs).select("digest", F.col("root").alias("print")).distinct(), "digest").select("root", "print").distinct()
    least = met.groupBy("print").agg(F.min("root").alias("a"))
    links = met.join(least, "print").where("root != a").select("a", F.col("root").alias("b"))
    merged = components(links).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return rows.join(merged, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")


def keep_one(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """One row of every group of near copies, with its own columns: the one of the smallest id; among several of that id the
    one of the smallest text hash. With ``fingerprints`` the links of ``simhash`` count as well.

    Whole texts are compared. Texts without words, null ones too, are copies of each other. A row with a null id stays only
    if its whole group has null ids. Of rows equal in id and text any one stays. Empty tables give no rows.
    """
    rows = written(rooted(docs), "near-rows")
    first = (_with_fingerprints(docs, rows) if fingerprints else rows).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("chosen_id"), F.col("f.digest").alias("chosen_digest"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), _digest(docs).alias("own_digest"))
    kept = row.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_digest") == F.col("chosen_digest")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_digest"]).select("row.*")
