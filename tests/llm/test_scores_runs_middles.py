"""Context-tree scores, periodic runs and fill-in-middle against brute force, on odd rows and on the small table."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import context_tree, fill_middle, periodic_runs
from ledgerline.llm.queries import QUERIES

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def clashing(odd):
    return odd.select("*", *[F.lit(7).alias(c) for c in ("n", "form", "output", "h", "a", "b", "chunk", "kind", "gram", "word", "n_runs", "runs", "period", "score")])


# Scores

def plain_scores(data, depth):
    """One row per (id, text): every bit by the quotient of two weighted probabilities, with and without it."""
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0

    def steps(text):
        whole = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(whole)):
            for k in range(8):
                yield whole[i - depth : i], (1 << k) | (whole[i] >> (8 - k)), (whole[i] >> (7 - k)) & 1

    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for d, t in data:
        if not held(d):
            for context, choice, bit in steps(lower(t)):
                for k in range(depth + 1):
                    counts[context[depth - k :], choice][bit] += 1
                    if k:
                        children[context[depth - k + 1 :], choice].add(context[depth - k :])

    def estimate(pair):
        return math.lgamma(pair[0] + 0.5) + math.lgamma(pair[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(pair) + 1)

    done = {}

    def weighted(context, choice):
        if (context, choice) not in done:
            own = estimate(counts.get((context, choice), (0, 0)))
            if len(context) < depth:
                own = np.logaddexp(own, sum(weighted(c, choice) for c in children.get((context, choice), ()))) - math.log(2)
            done[context, choice] = own
        return done[context, choice]

    def step(context, choice, bit):
        """Logarithm of the weighted probability at the root after one more bit, less that before it."""
        above = None
        for k in range(depth, -1, -1):
            here = context[depth - k :]
            pair = list(counts.get((here, choice), (0, 0)))
            pair[bit] += 1
            after = estimate(pair)
            if k < depth:
                longer = context[depth - k - 1 :]
                below = sum(weighted(c, choice) for c in children.get((here, choice), ())) + above - weighted(longer, choice)
                after = np.logaddexp(after, below) - math.log(2)
            above = after
        return above - weighted(b"", choice)

    words = Counter(w for d, t in data if not held(d) for w in [*WORD.findall(lower(t).decode()), ""])
    whole = sum(words.values()) + 0.1 * (len(words) + 1)
    rows = []
    for d, t in data:
        tokens = [*WORD.findall(lower(t).decode()), ""]
        base = sum(math.log10((words[w] + 0.1) / whole) for w in tokens)
        rows.append((d, held(d), len(tokens), sum(words[w] > 0 for w in tokens), sum(words.values()), base, sum(step(*s) for s in steps(lower(t))) / math.log(10)))
    return sorted(rows, key=repr)


def same_scores(df, want):
    got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_scores_equal_brute_force(spark, clashing, odd_rows):
    few = [(d, t if t is None else t[:700]) for d, t, *_ in odd_rows]
    docs = clashing.withColumn("text", F.substring("text", 1, 700))
    same_scores(context_tree.scored(docs), plain_scores(few, context_tree.DEPTH))


def test_scores_do_not_depend_on_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 900")
    once = {tuple(r)[0]: tuple(r)[1:] for r in context_tree.scored(docs).collect()}
    counted = docs.select(F.col("doc_id").alias("gram")).limit(0)
    assert context_tree.gram_logs(counted.withColumn("n", F.lit(1).cast("long"))).count() == 0
    chunks = context_tree.asked(docs, chunk_bytes=3000).where("kind = 2").select("chunk").distinct().count()
    again = {tuple(r)[0]: tuple(r)[1:] for r in context_tree.scored(docs.repartition(3), chunk_bytes=3000).collect()}
    assert chunks > 5 and once.keys() == again.keys()
    assert all(np.allclose([float(x) for x in once[k]], [float(x) for x in again[k]], rtol=1e-9) for k in once)


def test_small_blocks_give_the_same_logs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 600")
    counted = context_tree.asked(docs, 4).where("kind = 0").groupBy("gram").agg(F.sum("n").alias("n"))
    large = dict(map(tuple, context_tree.gram_logs(counted, 4, 2).collect()))
    small = dict(map(tuple, context_tree.gram_logs(counted, 4, 2, block=50).collect()))
    deep = dict(map(tuple, context_tree.gram_logs(counted, 4, 3).collect()))
    assert large.keys() == small.keys() == deep.keys() and len(large) > 3000
    assert all(abs(large[k] - small[k]) < 1e-9 and abs(large[k] - deep[k]) < 1e-9 for k in large)


def test_probabilities_of_all_next_bytes_sum_to_one():
    keys = np.unique(context_tree.grams([b"banana bandana", b"an ant"], 3)[0])
    every = np.unique(((keys >> 8)[:, None] << 8 | np.arange(256)).reshape(-1))
    counts = np.isin(every, keys) * 5
    levels = context_tree._levels(every, counts, 3, 1)
    top = len(levels[-1].node)
    logs = context_tree._gram_logs(levels, len(every), np.zeros(top), np.zeros(top), np.ones(top), every)
    assert np.allclose(np.exp(logs).reshape(-1, 256).sum(1), 1)


def test_held_out_texts_cost_less_than_by_the_base(spark, sf):
    row = context_tree.scored(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert row[2] > 50 and row[0] > row[1]


def test_scores_of_nothing(spark, empty):
    assert context_tree.scored(empty).count() == 0
    only = spark.createDataFrame([(d, "ab") for d in range(300) if context_tree.held_out(d)][:2], "doc_id long, text string")
    for r in context_tree.scored(only).collect():  # nothing to learn from: every bit is a coin
        assert r["train_tokens"] == 0 and r["base_score"] == 0 and math.isclose(r["bits_per_byte"], 8) and r["n_bytes"] == 2


# Runs

def plain_runs(words):
    """Every period, every place: stretches that equal themselves p later, each under its smallest period."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_periodic(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1] * math.lcm(*[x[2] for x in found]) // r[2], r[0], r[2])) if found else None
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, digest("".join(f"{s},{c},{p}\n" for s, c, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_common_lengths_equal_plain_comparison():
    r = random.Random(4)
    for size in (1, 5, 14, 90, 300):
        words = np.array([*(r.randrange(2) for _ in range(size)), 9])
        lce = periodic_runs.Lce(words)
        pairs = [r.sample(range(size + 1), 2) for _ in range(300)]
        want = []
        for i, j in pairs:
            k = 0
            while max(i, j) + k <= size and words[i + k] == words[j + k]:
                k += 1
            want.append(k)
        assert lce(*np.array(pairs).T).tolist() == want


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, letters = r.choice([0, 1, 5, 6, 7, 20, 60, 150]), r.choice([1, 2, 3, 30])
            t = [r.randrange(letters) for _ in range(n)]
            if n > 8 and r.random() < 0.6:
                a = r.randrange(n)
                p = 1 + (n - a) // (3 + r.randrange(8))
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(t, np.int64))
        for t, found in zip(texts, periodic_runs.runs(texts)):
            assert [tuple(x) for x in found.tolist()] == plain_runs(t.tolist())


def test_periodic_query_equals_brute_force(spark, clashing, odd_rows, sf, monkeypatch):
    data = [(d, t) for d, t, *_ in odd_rows if len(t or "") < 9000]
    docs = clashing.where("text IS NULL OR length(text) < 9000")
    query = lambda df: periodic_runs.periodic(df, periodic_runs.planted).select(
        *COLUMNS[:6], F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    assert sorted(map(tuple, query(docs).collect()), key=repr) == sorted((plain_periodic(d, t) for d, t in data), key=repr)
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_cover_lce_runs"](spark, sf).select(*COLUMNS).collect()), key=repr)
    assert got == sorted((plain_periodic(d, t) for d, t in given), key=repr)
    at_once = [(n, found.tolist(), text) for n, found, text in periodic_runs._found_in(given, periodic_runs.planted)]
    monkeypatch.setattr(periodic_runs, "TOGETHER", 300)
    assert [(n, found.tolist(), text) for n, found, text in periodic_runs._found_in(given, periodic_runs.planted)] == at_once


def test_runs_of_long_and_empty_texts(spark, empty):
    assert periodic_runs.periodic(empty).count() == 0
    unit = prose(5, 400)
    long_, one = " ".join([unit] * 50 + ["end"]), "go " * 30_000
    rows = {r["doc_id"]: r for r in periodic_runs.periodic(spark.createDataFrame([(1, long_), (2, one), (3, " ")], "doc_id long, text string")).collect()}
    assert (rows[1]["start"], rows[1]["length"], rows[1]["period"], rows[1]["collapsed"]) == (0, 20_000, 400, unit + " end")
    assert (rows[2]["length"], rows[2]["period"], rows[2]["n_runs"], rows[2]["collapsed"]) == (30_000, 1, 1, "go")
    assert (rows[3]["n_words"], rows[3]["n_runs"], rows[3]["start"], rows[3]["collapsed"]) == (0, 0, None, "")


# Fill-in-middle

def plain_middle(doc_id, text):
    text = text or ""
    n, digits = len(text), digest("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, digest(text), digest(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, b - a, digest(out), digest(text))


def middles(df):
    made = fill_middle.transform(df)
    return sorted((tuple(r) for r in made.select(
        "doc_id", "n", "form", "prefix_units", "middle_units", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)).collect()), key=repr)


def test_middles_equal_plain_slices(spark, clashing, odd_rows, empty):
    assert middles(clashing) == sorted((plain_middle(d, t) for d, t, *_ in odd_rows), key=repr)
    made = fill_middle.transform(clashing)
    assert made.select("a", "h", "row").distinct().collect() == [(7, 7, 7)] and made.columns.count("n") == made.columns.count("form") == 1
    assert fill_middle.transform(empty).count() == 0


def test_middles_of_marks_dollars_and_long_texts(spark):
    r = random.Random(2)
    texts = ["a<P>b", "<M>", "<P", "<<<>>><S", "$1\\2$\\E\\Q", "<S", "\n\n", "é😀" * 400, "".join(r.choice("<PSM>$\\ \n") for _ in range(40)), "word " * 200_000, *[c * 3 for c in "<P>$\\"]]
    data = [(k * 100 + i, t) for k, t in enumerate(texts) for i in range(12 if len(t) < 9000 else 2)]
    assert middles(spark.createDataFrame(data, "doc_id long, text string")) == sorted((plain_middle(d, t) for d, t in data), key=repr)


def test_units_of_words_and_lines_come_back(spark):
    data = [(k, t) for k, t in enumerate(["one two  three", " a\n\nb c\n", "x", "two\nlines", "last\n", "tail   ", "w " * 5000] * 12)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for unit, size in ((fill_middle.WORD_UNIT, lambda t: len(t.split())), (fill_middle.LINE_UNIT, lambda t: len(t.splitlines()))):
        made = fill_middle.transform(df, unit).select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert all(r["n"] == size(r["text"]) and r["back"] == r["text"] for r in made)
        assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_marks_must_not_arise_across_edges():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Markers(*bad)
