"""Line dedup by winnowing over line hashes.

A run of consecutive lines with at least ``MIN_WORDS`` words that stood earlier in the corpus is deleted, line by line; the
first one stays. Documents are ordered by id, lines by place. Lines without words are passed over.

For every line the shortest run of ``MIN_WORDS`` words from it on is a window, and the shortest one up to it. Inside, shorter runs (grams) have hashes; the
smallest one in a window is its fingerprint, a choice that depends on the window's lines alone, so equal windows have equal
fingerprints wherever they stand. Only fingerprints found at two places or more lead on: the match is extended both ways to
the windows around it, whose whole contents are compared, and overlapping repeated windows join to runs of any length.

Every line of a repeated run of ``MIN_WORDS`` words or more lies in a repeated window, so maximal runs go whole, up to both
their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, body, joined_id, split_id, written

MIN_WORDS = 50
GRAM_WORDS = 25


def _run_ends(before: np.ndarray, least: int) -> np.ndarray:
    """For each line the last line of the shortest run from it on with ``least`` words; len(lines) where there is none."""
    return np.searchsorted(before, before[:-1] + least, side="left") - 1


def _run_starts(before: np.ndarray, least: int) -> np.ndarray:
    """For each line the first line of the shortest run with ``least`` words that ends on it; -1 where there is none."""
    return np.searchsorted(before, before[1:] - least, side="right") - 1


def windows(text: str, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(first line, last line, fingerprint, 128-bit content hash) of every window; lines are numbered in the whole text.

    Whether a run is a window follows from its own lines, so all its copies are windows. A run that is one in both ways comes once.
    """
    stripped = [(k, s, len(s.encode("utf-8", "surrogatepass").split())) for k, line in enumerate(text.split("\n")) if (s := line.strip(BLANKS))]
    n = len(stripped)
    before = np.zeros(n + 1, np.int64)
    np.cumsum([w for _, _, w in stripped], out=before[1:])
    if before[-1] < min_words:
        return []
    hashes = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for _, s, _ in stripped]
    gram_end, window_end = _run_ends(before, gram_words), _run_ends(before, min_words)
    grams = [xxhash.xxh64_intdigest(b"".join(hashes[i : gram_end[i] + 1])) >> 1 if gram_end[i] < n else 0 for i in range(n)]
    bounds = [(i, int(j)) for i, j in enumerate(window_end) if j < n]
    bounds += [(int(i), j) for j, i in enumerate(_run_starts(before, min_words)) if i >= 0 and window_end[i] != j]
    found = []
    for i, j in bounds:
        inside = min(grams[s] for s in range(i, j + 1) if gram_end[s] <= j)
        found.append((stripped[i][0], stripped[j][0], inside, xxhash.xxh3_128_digest(b"".join(hashes[i : j + 1]))))
    return found


def placed_windows(docs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """doc_id, digest and the windows of every whole text."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, g, *w) for d, k, g, text in zip(batch["doc_id"], batch["known"], batch["digest"], batch["text"]) for w in windows(text, min_words, gram_words)]
            yield pd.DataFrame(rows, columns=["doc_id", "known", "digest", "first", "last", "fingerprint", "content"])

    text = body(docs)
    rows = docs.select(*split_id(docs), F.xxhash64(text, F.octet_length(text)).alias("digest"), text.alias("text"))
    return joined_id(rows.mapInPandas(emit, "doc_id long, known boolean, digest long, first int, last int, fingerprint long, content binary"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"), F.col("first"), F.col("last"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """doc_id, digest, deleted (array of first and last line): the repeated windows of every document that has some.

    Every step is a sum per hash, joined back; no two occurrences are ever paired with each other.
    """
    placed = written(placed_windows(docs, min_words, gram_words), "line-windows")
    again = placed.groupBy("fingerprint").agg(F.min(_place()).alias("a"), F.max(_place()).alias("z")).where("a != z").select("fingerprint")
    near = placed.join(again, "fingerprint", "left_semi")
    origin = near.groupBy("content").agg(F.min(_place()).alias("origin"), F.max(_place()).alias("z")).where("origin != z").select("content", "origin")
    later = near.join(origin, "content").where(_place() != F.col("origin"))
    same = (F.col("origin.digest") == F.col("digest")) & F.col("origin.doc_id").eqNullSafe(F.col("doc_id"))
    start = F.when(same, F.greatest("first", F.col("origin.last") + 1)).otherwise(F.col("first"))  # a run that overlaps its own origin
    spans = later.select("doc_id", "digest", F.struct(start.alias("first"), "last").alias("span")).where("span.first <= span.last")
    return spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("span")).alias("deleted"))


def _cut(text: str, spans) -> tuple[str, int, int]:
    """The text without the lines of the spans, its number of lines, and how many went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["last"] + 1] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    return "\n".join(line for line, s in zip(lines, stays) if s), len(lines), int((~stays).sum())


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with the shortened text, and n_lines, n_deleted_lines.

    All texts are compared whole. A null text stays null (no lines); a text all of whose lines stood earlier becomes empty.
    Rows equal in id and text are one document and are cut alike. Null ids come last in the order. Columns named as the two
    counts are replaced; all others stay. An empty table stays empty.
    """
    spans = repeats(docs, min_words, gram_words).withColumnsRenamed({"doc_id": "span_doc_id", "digest": "span_digest"})
    text = body(docs)
    other = [c for c in docs.columns if c not in ("n_lines", "n_deleted_lines")]
    row = docs.select(F.struct(*[docs[c] for c in other]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(text, F.octet_length(text)).alias("own_digest"))
    joined = row.join(spans, F.col("own_id").eqNullSafe(F.col("span_doc_id")) & (F.col("own_digest") == F.col("span_digest")), "left")
    whole = F.col("row.text").cast("string")
    return (
        joined.withColumn("cut", F.when(F.col("deleted").isNotNull(), shortened(whole, F.col("deleted"))))
        .select(
            *[(F.coalesce("cut.text", whole) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in other],
            F.coalesce("cut.n_lines", F.size(F.split(whole, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce("cut.n_deleted", F.lit(0)).cast("long").alias("n_deleted_lines"),
        )
    )


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())]))
def shortened(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_cut(t or "", () if s is None else s) for t, s in zip(texts, spans)], columns=["text", "n_lines", "n_deleted"])
