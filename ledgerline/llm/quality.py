"""Quality rules whose cut-offs carry a guarantee.

Every rule is a measure of a text in thousandths. A rung of the ladder cuts all measures at one height, and the ladder leads
from mild to strict. Labelled documents show, per stratum, how many good ones a rung would reject through any of its rules.
A rung may be used when an exact binomial test rejects "it rejects more than ``risk`` of the good documents"; the ladder is
walked from its mild end and stops at the first failure, so a stratum's walk needs no division among its rungs or rules. The
level is divided among the strata that have labels enough to pass at all, by Holm's steps: a stratum that passes its whole
ladder leaves its part to the others. So with probability 1 - ``level`` no rung in use breaks its limit. Among the allowed
rungs a stratum takes the mildest that rejects the most bad documents net of good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines")

#: measure: (numerator, denominator). Per 1000 of the denominator, at most 1000 for shares; a rule rejects what lies above its cut-off.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "capitals": ("n_upper", "n_letters"),
    "repeats": ("n_repeat_words", "n_words"),
    "copied_lines": ("n_dup_lines", "n_lines"),
}
#: Rungs in thousandths, from mild to strict; a document is rejected where any measure lies above.
LADDER = (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50)
RISK = 0.02
LEVEL = 0.05


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight found twice or more in the text.

    Windows get exact names by doubling: equal pairs of words get one number, then equal pairs of those, and again.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    name = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    width = 1
    while width < WINDOW:
        pair = name[:-width] * np.int64(n + 1) + name[width:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or ""
    utf8 = text.encode("utf-8", "surrogatepass")
    words = utf8.split()  # of bytes: splits at exactly the six characters of BLANKS
    raw = np.frombuffer(utf8, np.uint8)
    upper = ((raw >= 65) & (raw <= 90)).sum()
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), lines - len(seen), _repeated_words(words),
        int(upper), int(upper + ((raw >= 97) & (raw <= 122)).sum()), sum(map(text.count, "!?")), lines,
    )


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")


#: Told to be nondeterministic, so that a filter on the counts stays above them and no text is counted twice.
counted = F.pandas_udf(_counts, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])).asNondeterministic()


def stratum(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (the language; empty where null) and the counts of every whole text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), stratum(docs).alias("stratum"), counted(docs["text"].cast("string")).alias("c")).select("doc_id", "stratum", "c.*")


def _thousandths(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) * 1000 / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_tail(rejected: int, n: int, risk: float) -> float:
    """P(X <= rejected) for X binomial with n trials of probability ``risk``: the p-value of "the true rate is above risk"."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk) for i in range(rejected + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: list[int], bad: list[int], risk: float, level: float) -> int | None:
    """The index of the cut-off to use. ``good[i]``/``bad[i]``: labelled rows whose first exceeded cut-off is i; the last entry counts the rest."""
    n_good, n_bad = sum(good), sum(bad)
    lost = gained = 0
    best, found = 0.0, None
    for i in range(len(good) - 1):
        lost, gained = lost + good[i], gained + bad[i]
        if binomial_tail(lost, n_good, risk) > level:
            break
        net = gained / max(n_bad, 1) - lost / max(n_good, 1) * 20
        if net > best + 1e-12:
            best, found = net, i
    return found


def least_labels(risk: float, level: float) -> int:
    """Good labels below which even a rung that loses none of them is not allowed."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def whole_ladder(good: list[int], risk: float) -> float:
    """The p-value of a stratum's whole ladder: the largest among its rungs."""
    return max(binomial_tail(lost, sum(good), risk) for lost in np.cumsum(good[:-1]).tolist())


def shared_level(ladders: list[float], strata: int, level: float) -> float:
    """The level each stratum tests at, by Holm's steps over the p-values of whole ladders; those above ``level`` can be left out."""
    left = strata
    for p in sorted(ladders):
        if left == 1 or p > level / left:
            break
        left -= 1
    return level / max(left, 1)


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, cutoff: in thousandths, for all rules; null where no rung is allowed or none helps.

    ``risk`` bounds the share of good documents a stratum loses to all its rules together. All labelled rows are used. They
    meet the counts in one join; what follows are sums over strata x rungs, and one number per stratum that passes its whole
    ladder on the driver.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    worst = F.greatest(*[_thousandths(r) for r in RULES])
    rung = F.size(F.filter(F.array(*[F.lit(float(c)) for c in LADDER]), lambda c: c >= worst))  # rungs not exceeded come first
    cells = counts.select("doc_id", "stratum", rung.alias("rung")).join(good, "doc_id").groupBy("stratum", "rung").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))

    def tested(cell: pd.DataFrame) -> pd.DataFrame:
        by = {k: np.bincount(cell["rung"], cell[k], len(LADDER) + 1).astype(int).tolist() for k in ("good", "bad")}
        return pd.DataFrame({"stratum": [cell["stratum"].iloc[0]], **{k: [v] for k, v in by.items()}, "n_good": [sum(by["good"])], "whole": [whole_ladder(by["good"], risk)]})

    ladders = written(cells.groupBy("stratum").applyInPandas(tested, "stratum string, good array<long>, bad array<long>, n_good long, whole double"), "quality-ladders")  # a rung a row
    able = ladders.where(F.col("n_good") >= least_labels(risk, level))
    each = shared_level([r["whole"] for r in able.where(F.col("whole") <= level).select("whole").collect()], able.count(), level)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [choose(list(g), list(b), risk, each) for g, b in zip(batch["good"], batch["bad"])]
            yield pd.DataFrame({"stratum": batch["stratum"], "cutoff": [None if k is None else float(LADDER[k]) for k in found]})

    return ladders.mapInPandas(pick, "stratum string, cutoff double")


def verdicts(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Counts with base_failed, kept and the names of the rules that reject a document.

    A document fails the base rules with fewer than 20 words or more than 30 % of its words in repeated windows. A stratum
    without labels, or without an allowed rung, is judged by the base rules alone.
    """
    fired = F.filter(F.array(*[F.when(_thousandths(r) > F.col("cutoff"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        counts.join(cuts.select("stratum", "cutoff"), "stratum", "left").withColumn("base_failed", failed).withColumn("rules", F.concat_ws(",", fired))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rules") == ""))
    )


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, counts, base_failed, rules, kept.

    Whole texts are counted; null and empty ones have no words and fail the base rules. Rows with one id are judged each by
    its own text; if they are labelled, each counts as a labelled document. A null id is never labelled. Labels that
    contradict each other count as bad. Empty tables give no rows, or base verdicts alone. Only doc_id, text and lang are read.
    """
    counts = written(measured(docs), "quality-counts")
    return verdicts(counts, cutoffs(counts, labels, risk, level))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Each text is counted once: rows are written beside their counts,
    and the cut-offs read the counts alone."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    beside = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), stratum(docs).alias("stratum"), counted(docs["text"].cast("string")).alias("c"))
    counts = written(beside.select("row", "doc_id", "stratum", "c.*"), "quality-rows")
    cuts = written(cutoffs(counts.drop("row"), labels, risk, level), "quality-cuts")
    return verdicts(counts, cuts).where("kept").select("row.*")
