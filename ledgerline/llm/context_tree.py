"""Language-model scores by context-tree weighting over bytes, beside a smoothed word unigram as base.

A byte is eight binary choices; each choice has a tree of contexts, the 0 to ``DEPTH`` bytes before it. Every node counts
zeros and ones and estimates them after Krichevsky and Trofimov; a node's weighted probability is the mean of its own
estimate and the product of its children's. That fixes, for every node, how far its estimate is trusted against the longer
contexts below it, so a text's probability mixes all depths. A text is its lower-cased (A-Z) bytes and an end byte that
no text holds; it begins in a context of end bytes. Minus the binary logarithm is its code length.

How it runs:

1. Texts gather into chunks of some 32 MB. A chunk asks once for each distinct gram (``DEPTH`` bytes and the next) and each
   distinct word in it, and says how often its training documents hold them. What is gathered grows with the corpus.
2. Spark sums these counts over all chunks. Grams go to their contexts' last ``TOP`` bytes; below such a context there are
   at most 256 ** (DEPTH + 1 - TOP) grams, whatever the corpus, and blocks of whole contexts are weighed with arrays.
   Levels above are sums by node, at most 255 * 256 ** (TOP - 1) of them. From the root down, each node passes on what its
   estimate got and what is left for the longer contexts, until every gram has its probability.
3. The answers go back to the chunks that asked, sorted before their texts, and texts are scored one after the other.

No pair of documents or positions is ever formed; a worker holds one chunk's grams and words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, discard, split_id, stored, written

DEPTH = 5
#: Bytes of context by which grams are brought together.
TOP = 3
END = 255
#: A chunk ends after so many bytes, distinct grams or distinct words.
CHUNK_BYTES, CHUNK_GRAMS, CHUNK_WORDS = 32_000_000, 3_000_000, 1_000_000
#: Bytes whose grams are formed at once, and grams weighed at once.
AT_ONCE = 2_000_000
BLOCK = 300_000
#: The base model's addend.
ADDEND = 0.1
HELD_OUT_OF = 10


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


# Grams


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all bytes and ends of some texts, and where each text's begin.

    A gram is a number: the byte before, the one before that, and so on, then the byte itself. Equal long contexts are so
    next to each other in order, below the shorter ones that they end in.
    """
    gap = bytes([END]) * depth
    raw = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(depth + np.arange(len(texts)) * (depth - 1), sizes)
    own = raw.astype(np.int64)
    key = own.copy()
    for back in range(1, depth + 1):
        key[back:] |= own[: len(own) - back] << (8 * (depth + 1 - back))
    return key[at], np.concatenate([[0], ends])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)


# Krichevsky-Trofimov estimates and weights


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series from x + 8 on."""
    below = np.zeros_like(x)
    for k in range(8):
        below += np.log(x + k)
    z = x + 8
    inverse = 1 / z
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    a, b = np.asarray(zeros, float), np.asarray(ones, float)
    return np.where(a + b == 0, 0.0, _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1))


def log_weighted(estimate: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of an inner node: the mean of its own estimate and of the product of its children's weighted probabilities."""
    return np.logaddexp(estimate, below) - math.log(2)


class _Level:
    """The nodes of one depth in a block: context and binary choice, counts, and where the next longer ones hang."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.of = np.unique(keys, return_inverse=True)
        add = lambda v: np.bincount(self.of, v, len(self.node))
        self.zeros, self.ones = add(zeros), add(ones)
        self.estimate = log_estimate(self.zeros, self.ones)
        self.weighted = self.estimate if below is None else log_weighted(self.estimate, add(below))
        self.trust = np.ones(len(self.node)) if below is None else np.exp(self.estimate - self.weighted - math.log(2))


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[_Level]:
    """The levels of a block of grams, from the longest contexts to those of ``top`` bytes. Nodes are context * 256 + choice."""
    symbol, context = keys & 255, keys >> 8
    node, zero, one = [], [], []
    for k in range(8):
        bit = (symbol >> (7 - k)) & 1
        node.append((context << 8) | (1 << k) | (symbol >> (8 - k)))
        zero.append(np.where(bit == 0, counts, 0))
        one.append(np.where(bit == 1, counts, 0))
    levels = [_Level(np.concatenate(node), np.concatenate(zero), np.concatenate(one), None)]
    for _ in range(depth - top):
        last = levels[-1]
        levels.append(_Level(shorter(last.node), last.zeros, last.ones, last.weighted))
    return levels


def shorter(node):
    """The node of the same choice whose context lacks the farthest byte; of arrays as of columns."""
    if isinstance(node, Column):
        return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))
    return ((node >> 16) << 8) | (node & 255)


def _mixed(level: _Level, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the shorter contexts gave to zero and one, and left, after this level's estimate took its part."""
    total = level.zeros + level.ones + 1
    part = rest * level.trust
    return zero + part * (level.zeros + 0.5) / total, one + part * (level.ones + 0.5) / total, rest * (1 - level.trust)


def _gram_logs(levels: list[_Level], n: int, zero: np.ndarray, one: np.ndarray, rest: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The logarithm of each gram's probability, given what the nodes of the top level got from above."""
    for k in range(len(levels) - 1, -1, -1):
        if k < len(levels) - 1:
            up = levels[k + 1].of
            zero, one, rest = zero[up], one[up], rest[up]
        zero, one, rest = _mixed(levels[k], zero, one, rest)
    of, symbol = levels[0].of, keys & 255
    logs = np.zeros(n)
    for k in range(8):
        place = of[k * n : (k + 1) * n]
        logs += np.log(np.where((symbol >> (7 - k)) & 1 == 1, one[place], zero[place]))
    return logs


# Steps over tables

#: One table: packed documents, the grams that a chunk asks for, and its words.
_ASKED = "kind int, chunk long, docs binary, gram long, word binary, n long"
_GRAM, _WORD, _DOCS = 0, 1, 2
#: Stands for the end of a text among words, none of which is empty.
_END_WORD = b""
#: Bytes of text packed together.
PACKED = 1_000_000


def _pack(ids: list[int | None], texts: list[bytes]) -> bytes:
    """Documents as one compressed record batch: they travel twice, and texts compress to a third."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> tuple[list[int | None], list[bytes]]:
    table = pa.ipc.open_stream(data).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


class _Chunk:
    """The distinct grams and words of the texts so far, with their counts in training texts."""

    def __init__(self, number: int, depth: int, limit: int):
        self.number, self.depth, self.limit, self.bytes = number, depth, limit, 0
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: Counter = Counter()
        self.unseen: set[bytes] = set()
        self.wait: dict[bool, list[bytes]] = {True: [], False: []}
        self.waiting = 0

    def add(self, text: bytes, training: bool) -> None:
        words = text.split()
        if training:
            self.words.update(words)
            self.words[_END_WORD] += 1
        else:
            self.unseen.update(words, (_END_WORD,))
        self.wait[training].append(text)
        self.bytes += len(text) + 1
        self.waiting += len(text) + 1
        if self.waiting >= AT_ONCE:
            self.sum_up()

    def sum_up(self) -> None:
        parts, numbers = [self.grams], [self.counts]
        for training, texts in self.wait.items():
            if texts:
                distinct, times = np.unique(grams(texts, self.depth)[0], return_counts=True)
                parts.append(distinct)
                numbers.append(times if training else np.zeros_like(times))
        self.grams, self.counts = _summed(np.concatenate(parts), np.concatenate(numbers))
        self.wait, self.waiting = {True: [], False: []}, 0

    def full(self) -> bool:
        return self.bytes >= self.limit or len(self.grams) >= CHUNK_GRAMS or len(self.words) + len(self.unseen) >= CHUNK_WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.sum_up()
        yield _batch(len(self.grams), kind=_GRAM, chunk=self.number, gram=pa.array(self.grams), n=pa.array(self.counts))
        for word in self.unseen:
            self.words[word] += 0
        yield _batch(len(self.words), kind=_WORD, chunk=self.number, word=pa.array(list(self.words), pa.binary()), n=pa.array(list(self.words.values()), pa.int64()))


_ARROW = {"kind": pa.int32(), "chunk": pa.int64(), "docs": pa.binary(), "gram": pa.int64(), "word": pa.binary(), "n": pa.int64()}


def _batch(size: int, kind: int, chunk: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": pa.array(np.full(size, kind, np.int32)), "chunk": pa.array(np.full(size, chunk, np.int64))}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in _ARROW.items()], names=list(_ARROW))


def asked(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents, packed, with the chunk they belong to, and what every chunk asks: its distinct grams and words, n times in training texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(TaskContext.get().partitionId() << 32, depth, chunk_bytes)
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            return _batch(1, kind=_DOCS, chunk=chunk.number, docs=pa.array([_pack(ids, texts)], pa.binary()))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                text = text.lower()  # of bytes: A-Z alone
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 1
                chunk.add(text, not held_out(doc_id))
                if size >= PACKED or chunk.full():
                    yield packed()
                    ids, texts, size = [], [], 0
                if chunk.full():
                    yield from chunk.rows()
                    chunk = _Chunk(chunk.number + 1, depth, chunk_bytes)
        if ids:
            yield packed()
        if chunk.bytes:
            yield from chunk.rows()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text")).mapInArrow(emit, _ASKED)


def _blocks(frames: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Rows that come ordered by ``context``, some ``block`` at a time, a context never in two."""
    parts: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if size >= block and len(frame):
            edge = int(np.searchsorted(frame["context"].to_numpy(), parts[-1]["context"].iloc[-1], side="right"))
            if edge < len(frame):
                yield pd.concat([*parts, frame.iloc[:edge]])
                parts, size, frame = [], 0, frame.iloc[edge:]
        parts.append(frame)
        size += len(frame)
    if size:
        yield pd.concat(parts)


@F.pandas_udf(T.StructType([T.StructField("weighted", T.DoubleType()), T.StructField("trust", T.DoubleType())]))
def weigh(zeros: pd.Series, ones: pd.Series, below: pd.Series) -> pd.DataFrame:
    """Weighted probability of a node, and how far its own estimate is trusted against the longer contexts."""
    estimate = log_estimate(zeros.to_numpy(), ones.to_numpy())
    weighted = log_weighted(estimate, below.to_numpy())
    return pd.DataFrame({"weighted": weighted, "trust": np.exp(estimate - weighted - math.log(2))})


def gram_logs(counted: DataFrame, depth: int = DEPTH, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """gram, log (natural logarithm of the probability of its byte after its context) of a table gram, n without repeated grams."""
    if not 1 <= top < depth <= 6:
        raise ValueError("1 <= top < depth <= 6")
    below_top = 8 * (depth + 1 - top)
    keyed = counted.select(F.shiftright("gram", below_top).alias("context"), "gram", "n")

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _blocks(frames, block):
            last = _levels(frame["gram"].to_numpy(), frame["n"].to_numpy(), depth, top)[-1]
            yield pd.DataFrame({"node": last.node, "zeros": last.zeros, "ones": last.ones, "weighted": last.weighted})

    tops = written(keyed.repartition("context").sortWithinPartitions("context").mapInPandas(up, "node long, zeros double, ones double, weighted double"), "lm-nodes")
    levels, under = [], tops
    for k in range(top):
        sums = under.groupBy(shorter(F.col("node")).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        under = written(sums.select("node", "zeros", "ones", weigh("zeros", "ones", "below").alias("w")).select("node", "zeros", "ones", "w.*"), "lm-nodes")
        levels.append(under)
    share = lambda part, n: part * (F.col(n) + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    given = None
    for k, level in enumerate(reversed(levels)):
        if given is None:
            now = level.select("*", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("rest"))
        else:  # at most 255 * 256 ** (k - 1) nodes above
            now = level.join((F.broadcast(given) if k < 3 else given).withColumnRenamed("node", "above"), shorter(F.col("node")) == F.col("above"))
        part = F.col("rest") * F.col("trust")
        given = now.select("node", (F.col("zero") + share(part, "zeros")).alias("zero"), (F.col("one") + share(part, "ones")).alias("one"), (F.col("rest") * (1 - F.col("trust"))).alias("rest"))
    above = tops.select("node").join(given.withColumnRenamed("node", "above"), shorter(F.col("node")) == F.col("above"))
    none = F.lit(None)
    both = keyed.select("context", "gram", "n", none.cast("double").alias("zero"), none.cast("double").alias("one"), none.cast("double").alias("rest")).unionAll(
        above.select(F.shiftright("node", 8).alias("context"), F.col("node").alias("gram"), F.lit(-1).cast("long").alias("n"), "zero", "one", "rest")
    )

    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _blocks(frames, block):
            is_node = frame["n"].to_numpy() < 0
            nodes, own = frame[is_node].sort_values("gram"), frame[~is_node]
            keys = own["gram"].to_numpy()
            levels = _levels(keys, own["n"].to_numpy(), depth, top)
            logs = _gram_logs(levels, len(keys), *(nodes[c].to_numpy() for c in ("zero", "one", "rest")), keys)
            yield pd.DataFrame({"gram": keys, "log": logs})

    return both.repartition("context").sortWithinPartitions("context").mapInPandas(down, "gram long, log double")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def scored(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the documents that are not held out (nine ids in ten by a checksum of the id) and scores all, whole. Scores
    are decimal logarithms of probabilities; ``bits_per_byte`` is the code length over all bytes and the end. Null texts are
    empty texts: an end alone. Null ids stay null. Repeated rows each count and each get their score. Without training
    documents every bit has probability one half. Only doc_id and text are read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    path = stored(asked(docs, depth, chunk_bytes), "lm-chunks", by="kind")
    of_kind = lambda kind: spark.read.schema(_ASKED).parquet(path).where(F.col("kind") == kind)
    counted = stored(of_kind(_GRAM).groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    counted_words = stored(of_kind(_WORD).groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    words = spark.read.parquet(counted_words)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct")).first()
    tokens, distinct = int(total["tokens"]), int(total["distinct"])
    logs = stored(gram_logs(spark.read.parquet(counted), depth), "lm-logs")
    blank = {"docs": "binary", "gram": "long", "log": "double", "word": "binary", "n": "long"}
    shape = lambda df, kind: df.select("chunk", F.lit(kind).alias("kind"), *[c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    answers = spark.read.parquet(stored(of_kind(_GRAM).select("chunk", "gram").join(spark.read.parquet(logs), "gram"), "lm-answers"))
    counts = spark.read.parquet(stored(of_kind(_WORD).select("chunk", "word").join(words, "word"), "lm-answers"))
    for done in (counted, counted_words, logs, f"{path}/kind={_GRAM}", f"{path}/kind={_WORD}"):
        discard(spark, done)
    texts = of_kind(_DOCS).select("chunk", "docs")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _segments(batches):
            model = _Answers(tokens, distinct, depth)
            for kind, part in parts:
                if kind == _DOCS:
                    yield from map(model.scores, part.column("docs").to_pylist())
                else:
                    model.take(kind, part)

    ordered = shape(answers, _GRAM).unionAll(shape(counts, _WORD)).unionAll(shape(texts, _DOCS)).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return ordered.mapInArrow(emit, _SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.RecordBatch]]]]:
    """Per chunk its rows, cut where the kind changes."""

    def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    yield int(chunk[a]), int(kind[a]), batch.slice(a, b - a)

    for number, group in groupby(pieces(), key=lambda p: p[0]):
        yield number, ((kind, part) for _, kind, part in group)


class _Answers:
    """What a chunk got back, and the scores of its texts."""

    def __init__(self, tokens: int, distinct: int, depth: int):
        self.depth, self.whole = depth, tokens + ADDEND * (distinct + 1)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[bytes, int] = {}
        self.grams: np.ndarray | None = None

    def take(self, kind: int, part: pa.RecordBatch) -> None:
        if kind == _GRAM:
            self.parts.append((part.column("gram").to_numpy(), part.column("log").to_numpy()))
        else:
            self.words.update(zip(part.column("word").to_pylist(), part.column("n").to_pylist()))

    def scores(self, packed: bytes) -> pa.RecordBatch:
        if self.grams is None:
            keys, logs = (np.concatenate(c) for c in zip(*self.parts))
            order = np.argsort(keys)
            self.grams, self.logs, self.parts = keys[order], logs[order], []
            self.shift = np.uint64(64 - max(8, int(len(keys) * 4 - 1).bit_length()))
            self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
            self.slots[self._slot(self.grams)] = np.arange(len(keys), dtype=np.int32)
        ids, texts = _unpack(packed)
        keys, bounds = grams(texts, self.depth)
        score = np.add.reduceat(self.logs[self._places(keys)], bounds[:-1]) / math.log(10)
        n_tokens, n_known, base = zip(*map(self._base, texts))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(map(held_out, ids), pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
            pa.array(map(len, texts), pa.int64()), pa.array(base, pa.float64()), pa.array(score),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each gram stands: by its slot, or by search where another gram took the slot."""
        place = self.slots[self._slot(keys)]
        lost = np.flatnonzero(self.grams[place] != keys)
        place[lost] = np.searchsorted(self.grams, keys[lost])
        return place

    def _base(self, text: bytes) -> tuple[int, int, float]:
        words = text.split()
        n = np.fromiter(map(self.words.__getitem__, [*words, _END_WORD]), np.int64, len(words) + 1)
        return len(n), int((n > 0).sum()), float(np.log10((n + ADDEND) / self.whole).sum())
