"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words that looks at some positions and ignores the others, so a substituted word at an
ignored position does not hide a passage. Every place of every document is hashed under every mask and looked up among the
hashes of the benchmark; each hit is then verified word by word along its diagonal.

A benchmark of up to ``SEEDS_AT_ONCE`` seeds is broadcast. A larger one never is: its bits are, in a filter of bounded size, and
the places that pass it, few but the true ones, are joined with the seeds by a shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, written

#: Offsets a mask looks at. Every window of 13 to 20 words of which at most a fifth is substituted holds a hit of one of
#: these (tests/llm go through all patterns).
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 5, 6), (0, 2, 5, 9, 10, 11), (0, 1, 2, 6, 8, 9))
#: Words up to which an item has masks of its own size.
SHORT = 12
#: Words of the window that must agree, or all words of a shorter item.
WINDOW = 20
#: Percent of the window's words that must be equal.
AGREE = 80
#: Seeds of the benchmark broadcast, some 130 MB as a hash table; of a larger benchmark only a filter is broadcast.
SEEDS_AT_ONCE = 1_000_000
#: The filter: 64-bit words of a block, bits a seed sets in its one block, and blocks at most (32 MB of bits). A block has 32 seeds
#: up to 8 million seeds; above, more places pass in vain and are dropped by the join.
BLOCK, BITS, BLOCKS = 16, 3, 1 << 18


def short_masks(size: int) -> tuple[tuple[int, ...], ...]:
    """Offsets in an item of ``size`` words, fewer than the masks above need: of all substitutions that ``AGREE`` allows, each
    leaves the words of some mask alone. Words are dealt to one group more than twice the substitutions; a mask ignores as
    many groups as there may be substitutions."""
    allowed = size - -(-size * AGREE // 100)
    groups = [range(g, size, min(size, 2 * allowed + 1)) for g in range(2 * allowed + 1)] if allowed else []
    ignored = combinations(groups, allowed) if allowed else [()]
    return tuple(tuple(k for k in range(size) if not any(k in g for g in some)) for some in ignored)


def words(text: Column) -> Column:
    """Hashes of the lower-cased words: runs of letters and digits."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(hashes: str, place: str, short: list[int], item: bool = False) -> Column:
    """The hash under each mask at one place; null where the mask reaches beyond the end. Masks of short items (``short``:
    their sizes) hold for whole items only."""
    at, size = F.col(place), F.size(hashes)
    looked = lambda m, k: F.xxhash64(F.lit(k), *[F.get(F.col(hashes), at + o) for o in m])
    each = [(m, m[-1] + 1, len(m) * 64 + m[-1], (size > SHORT) & (at + m[-1] < size) if item else at + m[-1] < size) for m in MASKS]
    for n in short:
        whole = (size == n) & (at == 0) if item else at + n <= size
        each += [(m, n, -(n * 64 + k), whole) for k, m in enumerate(short_masks(n))]
    return F.array(*[F.struct(F.when(holds, looked(m, k)).alias("seed"), F.lit(span).alias("span")) for m, span, k, holds in each])


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, b: the distinct items by their words; copies are represented by the smallest id."""
    each = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words(body(benchmark)).alias("b"))
    return each.where(F.size("b") > 0).groupBy("b").agg(F.min("item_id").alias("item_id")).select("item_id", "b")


def short_sizes(tests: DataFrame) -> list[int]:
    """The sizes of the items of at most ``SHORT`` words; only masks for these are looked up."""
    return sorted(r["n"] for r in tests.where(F.size("b") <= SHORT).select(F.size("b").alias("n")).distinct().collect())  # twelve at most


def item_seeds(tests: DataFrame, short: list[int]) -> DataFrame:
    placed = tests.select("item_id", "b", F.posexplode("b").alias("item_at", "word"))
    each = placed.select("item_id", "item_at", F.explode(_seeds("b", "item_at", short, item=True)).alias("s")).select("item_id", "item_at", "s.seed", "s.span")
    return each.where(F.col("seed").isNotNull()).distinct()


def _block(seed: str, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(seed), 10 * BITS), F.lit(blocks).cast("long"))


def _marks(seed: str) -> list[tuple[Column, Column]]:
    """The bits of its block that a seed sets: the word and the place in it."""
    cut = lambda low, n: F.shiftrightunsigned(F.col(seed), low).bitwiseAND(F.lit(n - 1)).cast("int")
    return [(cut(10 * k + 6, BLOCK), cut(10 * k, 64)) for k in range(BITS)]


def seed_filter(seeds: DataFrame, blocks: int) -> DataFrame:
    """block, bits: for each block of the filter that has seeds, its words with the bits of all of them."""
    one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    each = F.explode(F.array(*[F.struct(word.alias("word"), one(bit).alias("bit")) for word, bit in _marks("seed")]))
    none = F.lit(0).cast("long")
    marks = seeds.select(_block("seed", blocks).alias("block"), each.alias("m"))
    merged = marks.groupBy("block").agg(*[F.bit_or(F.when(F.col("m.word") == i, F.col("m.bit")).otherwise(none)).alias(f"w{i}") for i in range(BLOCK)])
    return merged.select("block", F.array(*[f"w{i}" for i in range(BLOCK)]).alias("bits"))


def screened(looked: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The places of ``looked`` whose seed may be one of the ``n`` seeds; none that is gets lost."""
    blocks = min(BLOCKS, max(1, n // 32))
    met = looked.join(F.broadcast(seed_filter(seeds, blocks)), _block("looked", blocks) == F.col("block"))  # at most BLOCKS rows
    for word, bit in _marks("looked"):
        met = met.where(F.call_function("getbit", F.get(F.col("bits"), word), bit) == 1)
    return met.drop("block", "bits")


def _near(df: DataFrame) -> DataFrame:
    """In place of the whole document's words (``w``) those that windows around the place can reach, where they start, and how many
    words there are."""
    start = F.greatest(F.lit(0), F.col("doc_at") - WINDOW)
    return df.withColumns({"from": start, "n_words": F.size("w"), "near": F.slice("w", start + 1, 2 * WINDOW)}).drop("w")


def _agreement() -> Column:
    """The most equal words in a window of the hit's diagonal that holds the seed: (window length, equal words, start in the item)."""
    size = F.least(F.lit(WINDOW), F.size("b"))
    low = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - size, F.col("item_at") - F.col("doc_at"))
    high = F.least(F.size("b"), F.col("item_at") + size, F.col("item_at") - F.col("doc_at") + F.col("n_words"))
    equal = F.transform(F.sequence(F.col("low"), F.col("high") - 1), lambda k: (F.get(F.col("near"), F.col("doc_at") - F.col("from") - F.col("item_at") + k) == F.get(F.col("b"), k)).cast("int"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("size")),
        lambda s: F.struct(F.aggregate(F.slice("equal", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x).alias("equal"), (F.col("low") + s).alias("start")),
    )
    return size, low, high, equal, F.array_max(sums)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest, item_id, n_equal, n_window, doc_at: the pairs that share a window, with their best one.

    A pair counts when ``WINDOW`` consecutive words (all of a shorter item) agree in at least ``AGREE`` percent, position by
    position, anywhere in the whole text. Copies within the benchmark are reported once, under the smallest id. Null and
    empty texts and items without words match nothing.
    Rows equal in id and text are reported once. Empty tables give no rows. Only doc_id, text and item_id, text are read.
    """
    tests = items(benchmark)
    short = short_sizes(tests)
    seeds = item_seeds(tests, short)
    n = seeds.count()
    text = body(docs)
    placed = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("digest"), words(text).alias("w"))
    # The words stay with every place by reference until a seed is found, within one generated loop.
    looked = placed.select("doc_id", "digest", "w", F.posexplode("w").alias("doc_at", "word")).select("doc_id", "digest", "w", "doc_at", F.explode(_seeds("w", "doc_at", short)).alias("s"))
    looked = looked.select("doc_id", "digest", "w", "doc_at", F.col("s.seed").alias("looked"))
    if n > SEEDS_AT_ONCE:
        seeds = written(seeds, "benchmark-seeds")
        places = _near(screened(looked, seeds, n))
        hits = places.join(seeds, F.col("looked") == F.col("seed"))
    else:
        hits = _near(looked.join(F.broadcast(seeds), F.col("looked") == F.col("seed")))
    size, low, high, equal, best = _agreement()
    verified = (
        hits.select("doc_id", "digest", "from", "n_words", "near", "doc_at", "item_id", "item_at", "span").join(tests, "item_id")
        .withColumns({"size": size, "low": low, "high": high}).where(F.col("high") - F.col("low") >= F.col("size"))
        .withColumn("equal", equal).withColumn("best", best).where(F.col("best.equal") * 100 >= F.col("size") * AGREE)
    )
    kept = F.max(F.struct(F.col("best.equal").alias("n_equal"), F.col("size").alias("n_window"), (F.col("doc_at") - F.col("item_at") + F.col("best.start")).alias("doc_at"))).alias("m")
    return verified.groupBy("doc_id", "digest", "item_id").agg(kept).select("doc_id", "digest", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with their own columns."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    text = body(docs)
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(text, F.octet_length(text)) == F.col("bad_digest")), "left_anti")
