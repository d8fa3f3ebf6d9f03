"""Runs of words: stretches that repeat their first few words four times or more, all of them, exactly.

Whether two places of a text continue alike, and for how long, is answered by a difference cover: of every ``COVER`` places
only the ``len(_COVER)`` sampled ones are sorted by what follows them, and any two places reach sampled ones after the same
few words, which are compared one by one. From there on a sparse table over the sorted samples gives the common length.

A run of period p and at least 4p words has at least 3p words that equal the one p later, so it holds a multiple of 3p
among their places: for every p only this grid is looked at, some n/3 * ln(n) places in all. Where a word equals the one p
later, the common lengths forward and backward give the whole stretch. Texts are taken together, a few hundred thousand
words at a time, with a word of its own between any two, so no stretch crosses from one into the next.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import body, joined_id, split_id

#: Every difference modulo 13 is one of two of these places.
COVER = 13
_COVER = np.array([0, 1, 3, 9])
#: A run holds its period so often, and so many words.
TIMES = 4
LEAST_WORDS = 6
#: Words of the texts taken together.
TOGETHER = 200_000


def _steps() -> np.ndarray:
    """For the residues of two places, the smallest step that brings both onto sampled places."""
    sampled = np.isin(np.arange(COVER), _COVER)
    step = np.arange(COVER)
    return np.array([[next(d for d in step if sampled[(i + d) % COVER] and sampled[(j + d) % COVER]) for j in step] for i in step])


_STEP = _steps()


class Lce:
    """Longest common extensions of places of one sequence of numbers >= 0 that does not repeat its last one."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.words = np.concatenate([words, -1 - np.arange(2 * COVER)])  # beyond the end all differ
        at = np.arange(n)
        self.sampled = at[np.isin(at % COVER, _COVER)]
        m = len(self.sampled)
        self.index = np.zeros(n + 2 * COVER, np.int64)
        self.index[self.sampled] = np.arange(m)
        # The first COVER words of every sampled place, named in order; then twice as many, until all names differ.
        name = self.words[self.sampled]
        for k in range(1, COVER):
            name = self._named(name, self.words[self.sampled + k])
        width = COVER
        while m and name.max() < m - 1:
            far = self.sampled + width
            beyond = np.where(far < n, name[self.index[np.minimum(far, n - 1)]], -1)
            name = self._named(name, beyond)
            width *= 2
        order = np.empty(m, np.int64)
        order[name] = np.arange(m)
        self.rank = name
        self.levels = self._sparse_table(self._neighbours(self.sampled[order]))

    @staticmethod
    def _named(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        low = low - low.min(initial=0)
        return np.unique(high * (low.max(initial=0) + 1) + low, return_inverse=True)[1].reshape(-1)

    def _neighbours(self, places: np.ndarray) -> np.ndarray:
        """Common length of each sampled place with the next one in order.

        Moving on by COVER words from a pair of neighbours shortens their common length by as much, and the place then next
        to the first shares no less; so along the places of one residue the comparison never starts anew.
        """
        m, words, common = len(places), self.words.tolist(), [0] * max(len(places) - 1, 0)
        after = np.full(m, -1)
        if m > 1:
            after[self.rank[self.index[places[:-1]]]] = places[1:]
        follower, rank, index = after.tolist(), self.rank.tolist(), self.index
        for r in _COVER:
            size = 0
            for i in range(int(r), self.n, COVER):
                k = rank[index[i]]
                j = follower[k]
                if j < 0:
                    size = 0
                    continue
                while words[i + size] == words[j + size]:
                    size += 1
                common[k] = size
                size = max(size - COVER, 0)
        return np.array(common, np.int64)

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        levels = [values]
        while 2 << (len(levels) - 1) <= len(values):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        return levels

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j are different places from 0 to n."""
        size = np.zeros(len(i), np.int64)
        step = _STEP[i % COVER, j % COVER]
        open_ = np.arange(len(i))
        for k in range(COVER):
            same = self.words[i[open_] + k] == self.words[j[open_] + k]
            open_ = open_[same & (step[open_] > k)]
            size[open_] += 1
        whole = np.flatnonzero((size == step) & (i + step < self.n) & (j + step < self.n))
        a, b = self.rank[self.index[i[whole] + step[whole]]], self.rank[self.index[j[whole] + step[whole]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            of = level == k
            size[whole[of]] += np.minimum(self.levels[k][low[of]], self.levels[k][high[of] - (1 << int(k))])
        return size


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, its words as numbers >= 0, the rows start, length, period of every run, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max() < LEAST_WORDS:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    own = max(int(t.max(initial=-1)) for t in texts) + 1
    # The sequence: every text, and behind it a number that stands nowhere else.
    words = np.concatenate([part for k, t in enumerate(texts) for part in (t, [own + k])]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    found: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero(sizes >= LEAST_WORDS)
    p = 1
    while len(live):  # the texts that have room for the period
        counts = (sizes[live] - p + 3 * p - 1) // (3 * p)
        text = np.repeat(live, counts)
        x = begin[text] + 3 * p * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
        hit = words[x] == words[x + p]
        if hit.any():
            found.append((x[hit], np.full(int(hit.sum()), p)))
        p += 1
        live = live[sizes[live] >= TIMES * p]
    if not found:
        return [np.zeros((0, 3), np.int64) for _ in texts]
    x, p = (np.concatenate(c) for c in zip(*found))
    # Most hits are single words: they end after a few more, seen without any table.
    near = np.ones(len(x), np.int64)
    last = len(words) - 1
    for way in (1, -1):
        alive = np.arange(len(x))
        for k in range(1, COVER):
            a = x[alive] + way * k
            inside = (a >= 0) & (a + p[alive] <= last)
            alive, a = alive[inside], a[inside]
            alive = alive[words[a] == words[a + p[alive]]]
            near[alive] += 1
    maybe = near >= np.minimum(np.maximum(LEAST_WORDS, TIMES * p) - p, COVER)
    x, p = x[maybe], p[maybe]
    if not len(x):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    # The tables are made for the texts that still have a hit.
    text = np.searchsorted(begin, x, side="right") - 1
    hit_texts, of = np.unique(text, return_inverse=True)
    whole = np.concatenate([np.arange(begin[k], begin[k] + sizes[k] + 1) for k in hit_texts])
    moved = np.concatenate([[0], np.cumsum(sizes[hit_texts] + 1)[:-1]])
    back = begin[hit_texts] - moved
    x = x - back[of]
    words = words[whole]
    forward, backward = Lce(words), Lce(words[::-1].copy())
    n = len(words)
    ahead, behind = forward(x, x + p), backward(n - 1 - x, n - 1 - (x + p))  # both count the place itself
    start, length = x - behind + 1, ahead + behind - 1 + p
    enough = length >= np.maximum(LEAST_WORDS, TIMES * p)
    rows = np.unique(np.stack([start[enough], length[enough], p[enough]], 1), axis=0)
    # A stretch is found again under multiples of its smallest period.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = np.searchsorted(moved, rows[:, 0], side="right") - 1
    rows[:, 0] -= moved[of]
    text = hit_texts[of]
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(edges[:-1], edges[1:])]


def longest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest quotient of length and period, exactly; of equal ones the first, then the shortest period."""
    best = None
    for start, length, period in found.tolist():  # by start, then period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: of every run only its first period does, unless another run drops that too."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the places of the original words that a text with a planted repetition is made of; a null id counts as an empty one."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


Change = Callable[[int | None, int], "np.ndarray | None"]


def _found_in(batch: Iterable[tuple[int | None, str]], change: Change | None) -> Iterator[tuple]:
    """n_words, runs and the collapsed text of each (id, text)."""
    group: list[tuple[list[bytes], np.ndarray]] = []
    number: dict[bytes, int] = defaultdict(count().__next__)
    size = 0

    def flush() -> Iterator[tuple]:
        for (words, _), found in zip(group, runs([ids for _, ids in group])):
            stays = kept_words(len(words), found)
            yield len(words), found, b" ".join(words if stays.all() else [words[k] for k in np.flatnonzero(stays)]).decode("utf-8", "surrogatepass")

    for doc_id, text in batch:
        words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at exactly the six characters of BLANKS
        at = change(doc_id, len(words)) if change else None
        if at is not None:
            words = [words[k] for k in at]
        group.append((words, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
        size += len(words)
        if size >= TOGETHER:
            yield from flush()
            group, number, size = [], defaultdict(count().__next__), 0
    yield from flush()


_RESULT = "doc_id long, known boolean, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def periodic(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed.

    Whole texts are read. ``runs`` lists every run as a line ``start,length,period``; the four columns before it are those of
    the run with most repetitions, null where there is none; ``collapsed`` is the text, its words joined by single spaces,
    with one period of each run left. ``change`` (id, number of words) may give other places to take the words from. Null
    and empty texts have no words and no runs; null ids stay null; repeated rows are answered each. Only doc_id and text are
    read. Empty tables give no rows. One scan, no shuffle; a worker holds the texts of one batch.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [d if k else None for d, k in zip(batch["doc_id"].tolist(), batch["known"].tolist())]
            out = []
            for n, found, collapsed in _found_in(zip(ids, batch["text"]), change):
                best = longest(found)
                four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                out.append((n, len(found), *four, "".join(f"{s},{c},{p}\n" for s, c, p in found.tolist()), collapsed))
            columns = list(zip(*out)) if out else [()] * 8
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "known": batch["known"], "n_words": columns[0], "n_runs": columns[1],
                **{c: pd.array(columns[k], dtype="Int64") for k, c in enumerate(("start", "length", "period", "exponent_milli"), 2)},
                "runs": columns[6], "collapsed": columns[7],
            })

    return joined_id(docs.select(*split_id(docs), body(docs).alias("text")).mapInPandas(emit, _RESULT))
