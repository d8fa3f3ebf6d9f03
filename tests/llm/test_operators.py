"""Operators against brute force, on odd rows and on the small table."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerline.llm import (
    components, decontaminate, golay, licences, line_dedup, near_copies, packing, quality, secret_scan, sharding, simhash, token_counts, token_files, tokens,
)

from .conftest import prose


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Near-duplicates

def test_golay_decodes_every_word_within_three_bits():
    words = np.arange(1 << 23)
    index = golay.decode(words)
    assert np.bincount(index).tolist() == [2048] * 4096
    near = golay.nearby(np.arange(0, 1 << 21, 997), 21)
    assert near.shape[1] == 6 and (near[:, 0] >= 0).all()


def test_keys_meet_for_all_patterns_of_three_bits():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 3000, dtype=np.uint64)
    flips = [sum(np.uint64(1) << np.uint64(p) for p in r.choice(64, r.integers(1, 4), replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    lie, look = simhash.keys(a)[0], simhash.keys(b)[1]
    assert all(set(x) & (set(y) - {-1}) for x, y in zip(lie.tolist(), look.tolist()))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_groups_equal_brute_force(spark, odd, odd_rows, sf):
    near = spark.createDataFrame([(100 + k, " ".join([*prose(9, 400).split()[:-1], str(k)])) for k in range(12)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(near)
    data = [tuple(r) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in data]
    root = list(range(len(data)))
    for _ in data:
        for i, j in combinations(range(len(data)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for (d, _), k in zip(data, root):
        least[k] += [d] if d is not None else []
    want = sorted(((d, f"{p:016x}", min(least[k], default=None)) for (d, _), p, k in zip(data, prints, root)), key=repr)
    assert rows(simhash.grouped(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs.withColumn("own_id", F.lit(1)))
    assert kept.count() == len(set(root)) and kept.columns == ["doc_id", "text", "own_id"]


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200, 201)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}, 200: 200, 201: 200}


def test_near_copies_equal_all_pairs(spark, odd):
    r = random.Random(6)
    made = []
    for k in range(6):  # groups with 0 to 12 changed words of 150: similarities on both sides of 0.8
        base = prose(700 + k, 150).split()
        for c in range(14):
            own = list(base)
            for at in r.sample(range(150), c % 13):
                own[at] = f"new{r.randrange(10**6)}"
            made.append((1000 + 20 * k + c, " ".join(own)))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    data = [tuple(x) for x in docs.collect()]
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(data)))
    links = [(i, j) for i, j in combinations(range(len(data)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for _ in data:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    far = sum((simhash.fingerprint(data[i][1]) ^ simhash.fingerprint(data[j][1])).bit_count() > 3 for i, j in links)
    assert far > 20
    want = sorted(min(((data[i][0] is None, data[i][0] or 0) for i in range(len(data)) if root[i] == k)) for k in set(root))
    got = near_copies.keep_one(docs.withColumn("own_id", F.lit(1)))
    assert got.columns == ["doc_id", "text", "own_id"]
    assert sorted((d is None, d or 0) for d, in rows(got, "doc_id")) == want


def test_near_copies_compare_all_that_meet(spark, monkeypatch):
    """Links that no pivot finds are found by the pairs left apart: here no pivot is ever drawn, and 0 is the smallest of no band."""
    none = lambda members, *a: members.select(F.col("node").alias("a"), F.col("node").alias("b")).where("a != b")
    monkeypatch.setattr(near_copies, "_with_pivots", none)
    sets = {k: [*range(1000 * (k // 10), 1000 * (k // 10) + 100 - k % 10)] for k in (*range(10, 16), *range(20, 25), 0)}
    table = spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, shingles array<long>")
    members = spark.createDataFrame([(1, k) for k in sets], "key long, node long")
    roots = spark.createDataFrame([(k, k) for k in sets], "node long, root long")
    got = {tuple(x) for x in near_copies.confirmed(near_copies._left_apart(members, roots, table), table).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(sets), 2) if a // 10 == b // 10}
    base = prose(761, 200).split()
    made = [(k, " ".join([*base[: 40 + 2 * k], f"new{k}", *base[41 + 2 * k :]])) for k in range(30)]
    assert near_copies.keep_one(spark.createDataFrame(made, "doc_id long, text string")).count() == 1


def test_near_copies_by_fingerprints(spark):
    """op1's links count in the pipeline's stage, also over similarities under 0.8; links of both kinds join into one group."""
    import corpus_pipeline

    r, made = random.Random(4), []
    shingled = lambda t: set(near_copies.shingles(t).tolist())
    similar = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    for k in range(4000):
        base = prose(50000 + k, 200).split()
        own = list(base)
        for at in r.sample(range(200), 6):
            own[at] = f"new{r.randrange(10**6)}"
        a, b = " ".join(base), " ".join(own)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3 and not similar(shingled(a), shingled(b)):
            made = [(1, a), (2, b), (3, b + " more"), (4, prose(49999, 200))]
            break
    assert made
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(near_copies.keep_one(docs), "doc_id") == [(1,), (2,), (4,)]
    assert rows(corpus_pipeline.near_duplicates(spark, docs, ""), "doc_id") == [(1,), (4,)]


def test_near_copies_recall(spark):
    """Planted copies of 0.8 to 0.95 in groups of 2 to 40, over one shared passage that alone makes no copy: at least 0.9 of all links found."""
    r = random.Random(11)
    shared, made = prose(799, 60), []
    for g, size in enumerate([2] * 30 + [5] * 12 + [40] * 3):
        base = prose(800 + g, 200).split()
        for c in range(size):
            own = list(base)
            for at in r.sample(range(200), r.choice([0, 1, 2, 2])):
                own[at] = f"new{r.randrange(10**6)}"
            made.append((len(made), shared + " " + " ".join(own)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in made)]
    links = [(i, j) for i, j in combinations(range(len(made)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    hard = sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in links)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    root = dict(rows(near_copies.rooted(docs), "doc_id", "root"))
    assert hard > 500 and sum(root[i] == root[j] for i, j in links) >= 0.9 * len(links)
    reach = list(range(len(made)))
    for _ in range(4):
        for i, j in links:
            reach[i] = reach[j] = min(reach[i], reach[j])
    same = defaultdict(set)
    for i, k in root.items():
        same[k].add(reach[i])
    assert all(len(v) == 1 for v in same.values())


def test_near_copies_recall_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    data = dict(rows(docs, "doc_id", "text"))
    sets = {d: frozenset(near_copies.shingles(t).tolist()) for d, t in data.items()}
    where = defaultdict(set)
    for s in set(sets.values()):
        for x in s:
            where[x].add(s)
    pairs = {frozenset((a, b)) for v in where.values() for a, b in combinations(v, 2)}
    near = [tuple(p) for p in pairs if len(p) == 2 and (lambda a, b: 10 * len(a & b) >= 8 * len(a | b))(*p)]
    root = dict(rows(near_copies.rooted(docs), "doc_id", "root"))
    of = {s: root[d] for d, s in sets.items()}
    assert len(near) >= 5 and sum(of[a] == of[b] for a, b in near) >= 0.9 * len(near)


# Shards

def test_shards_are_even_and_numbered(odd, odd_rows, sf, spark, tmp_path):
    got = sharding.shard(odd, shards=3, path=str(tmp_path / "map")).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows)
    big = spark.read.parquet(f"{sf}/documents.parquet")
    by = defaultdict(list)
    dealt = sharding.shard(big, path=str(tmp_path / "map24")).collect()
    for r in dealt:
        by[r["shard"]].append(r)
    loads = [sum(r["size"] for r in by[k]) for k in range(24)]
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert max(loads) - min(loads) <= max(r["size"] for r in dealt)
    again = sharding.load(spark, str(tmp_path / "map24"))
    assert again.version == 2 and sharding.load(spark, str(tmp_path / "map24"), 1) == sharding.SlotMap.first(24)
    weight = [0] * sharding.SLOTS
    for r in dealt:
        weight[r["virtual_slot"]] += r["size"]
    grown = again.grown(weight)
    assert {b for a, b in zip(again.owner, grown.owner) if a != b} == {24} and grown.shards == 25


# Secrets

PLAIN = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def plain_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, (rx, g, n)) in enumerate(PLAIN.items()) for m in rx.finditer(text or "") if len(m[g]) >= n]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_secrets_equal_plain_expressions(spark, odd, sf):
    made = ["password=abcdefgh", "PassWord' : \"short", "token: secret: abcdefgh12", "éé API_KEY=0123456789abcdef0123456789abcdef😀apikey=zzzzzzzz", "AKIAAKIA" + "A" * 20, "x" + "f" * 31 + "g" + "0" * 40, "toKen=" + "a" * 3000, "secret=secret=abcdefgh token=1 passwd=12345678"]
    docs = odd.select("doc_id", "text", "digest").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(made)], "doc_id long, text string, digest int"))
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text", F.lit(1)).toDF("doc_id", "text", "digest"))
    want = sorted(((d, [f"{k}:{s}:{e}" for s, e, k in plain_spans(t)]) for d, t in docs.select("doc_id", "text").collect()), key=repr)
    got = sorted(((r["doc_id"], [f"{x['kind']}:{x['start']}:{x['end']}" for x in r["spans"]]) for r in secret_scan.scan(docs).collect()), key=repr)
    assert got == want and any(s for _, s in got)


def test_trigram_queries_follow_the_patterns():
    q = secret_scan.queries()
    assert set(q) == {"assign", "access"} and q["access"] == [{(False, "AKI"), (False, "KIA")}] and len(q["assign"]) == 6
    assert {(True, g) for g in ("api", "pik", "ike", "key")} in q["assign"] and {(True, g) for g in ("tok", "oke", "ken")} in q["assign"]
    grams = lambda p: {frozenset(g for _, g in a) for a in secret_scan.trigram_query(p)}
    assert grams("ab(c|d)e?f") == {frozenset(x) for x in (("abc", "bce", "cef"), ("abc", "bcf"), ("abd", "bde", "def"), ("abd", "bdf"))}
    assert grams("gh[op]_+xyz") == {frozenset(("gho", "ho_", "xyz")), frozenset(("ghp", "hp_", "xyz"))}
    assert grams("(abc)?def") == {frozenset(("def",))} and grams("abc|[0-9]+") == {frozenset()} and grams("(abc){2,}") == {frozenset(("abc", "bca", "cab"))}


def test_a_new_rule_needs_its_pattern_only(spark):
    """Random patterns: the query holds on every text with a match, and the scan equals the plain expression."""
    r = random.Random(21)

    def pattern(depth):
        kind = r.randrange(7 if depth else 2)
        if kind < 2:
            return "".join(r.choice("abkX_") for _ in range(r.randrange(1, 5)))
        if kind == 2:
            return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})"
        if kind == 3:
            return f"(?:{pattern(depth - 1)}){r.choice(['?', '+', '{2}', '{1,3}', '*'])}"
        if kind == 4:
            return r.choice(["[ab]", "[^a]", "[a-k]", "(?i:ab)", "(?i:kX_a)"])
        return pattern(depth - 1) + pattern(depth - 1)

    texts = [" ".join("".join(r.choice("abkXAB_") for _ in range(r.randrange(3, 12))) for _ in range(6)) for _ in range(300)] + ["", "abXk" * 500]
    matched = queried = 0
    for _ in range(400):
        p = pattern(3)
        query, plain = secret_scan.trigram_query(p), re.compile(p, re.A)
        for t in texts:
            if plain.search(t):
                assert any(all(g in (t.lower() if fold else t) for fold, g in a) for a in query), (p, t)
                matched += 1
        queried += all(query)
    assert matched > 1000 and queried > 50
    rules = tuple(secret_scan.Rule(f"k{i}", p) for i, p in enumerate(["(?:ab|kX)_?[ab]+k", "(?i:xk)+_a", "[abk]{9,}", *[f"{a}{b}[X_]{c}" for a in "abkA" for b in "ab_B" for c in "aXkb"]]))
    assert len(secret_scan.vocabulary(rules)) > 63
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    want = {i: sorted((m.start(), k, m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, t, re.A)) for i, t in enumerate(texts)}
    assert {x["doc_id"]: [(s["start"], int(s["kind"][1:]), s["end"]) for s in x["spans"]] for x in got} == want
    alone = secret_scan.scan(spark.createDataFrame([(1, "a" * 40), (2, None)], "doc_id long, text string"), secret_scan.RULES[2:])  # no rule has a trigram
    assert dict(rows(alone.select("doc_id", F.size("spans").alias("n")), "doc_id", "n")) == {1: 1, 2: 0}


# Packing and token files

def test_pack_block_saves_what_best_fit_leaves():
    r = random.Random(2)
    for _ in range(40):
        lengths = [r.randrange(1, 101) for _ in range(r.randrange(1, 200))]
        bins = packing.pack_block(lengths, 100)
        loads = Counter()
        for n, b in zip(lengths, bins):
            loads[b] += n
        assert max(loads.values()) <= 100 and sorted(loads) == list(range(len(loads)))
        first = []  # best fit alone
        for n in sorted(lengths, reverse=True):
            room = [k for k, f in enumerate(first) if f + n <= 100]
            if room:
                first[max(room, key=lambda k: first[k])] += n
            else:
                first.append(n)
        assert -(-sum(lengths) // 100) <= len(loads) <= len(first)


def test_exchange_empties_a_bin():
    # Best fit alone needs four bins: 44+8+6, 24+24+8, 22+21+17 and 6.
    assert max(packing.pack_block([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)) == 2


def test_packed_pieces_hold_every_id(spark, odd, odd_rows, empty):
    tk = Tokenizer.from_file(tokens.tokenizer_path())
    got = packing.packed(odd).collect()
    whole = Counter()
    for d, t, *_ in odd_rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for i, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            whole[(d, i, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
            assert n == 2048 or i == 0
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == whole
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 2048
    assert packing.packed(empty).count() == 0
    docs = spark.createDataFrame([((1 << 60) + 1, prose(1, 900)), (None, prose(2, 30)), (3, None)], "doc_id long, text string")
    assert rows(packing.packed(docs), "doc_id")[-1] == (None,) and ((1 << 60) + 1,) in rows(packing.packed(docs), "doc_id")
    made = packing.sequences(docs, packing.packed(docs)).collect()
    assert sorted(i for r in made for i in r["ids"]) == sorted(i for t in (prose(1, 900), prose(2, 30), "") for i in tk.encode(t, add_special_tokens=False).ids + [0])


def test_words_encode_as_whole_texts():
    tk = Tokenizer.from_file(tokens.tokenizer_path())
    odd = ["", " ", "a  b", " a b ", "a \n b", "x<|endoftext|> y <|endoftext|>", "it's we'll 'tis", "a\x1cb \x1c c", "ab" * 20000, "​ x ᠎ y", None, "b. c, d.. ª º µ ø. ɏ, ŉ ×÷", "z  q"]
    encoder = tokens.IdEncoder(tokens.tokenizer_path())
    want = [np.array(tk.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert list(encoder.encode_all(odd)) == want == [encoder.encode(t) for t in odd]


def test_runs_of_letters_with_marks_pass_by_the_pattern(monkeypatch):
    tk = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["Head plain Plain! été*** thus,%%% ends.\nNext öffnet.\nDas, a_b __ tail_ x\ny a.b", "So (it) goes;\nit's so's. one!'\n'two end-- <|endoftext|> w<|endoftext|>"]
    encoder, sent = tokens.IdEncoder(tokens.tokenizer_path()), []
    by_pattern = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda parts: (sent.extend(parts), by_pattern(parts))[1])
    assert list(encoder.encode_all(texts)) == [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not {" Plain!", " été***", " thus,%%%", " ends.\nNext", " öffnet.\nDas,", " tail_"} & set(sent) and {" a.b", " it's"} - set(sent) == {" it's"}


def test_token_files_come_back(spark, odd, odd_rows, empty, tmp_path):
    tk = Tokenizer.from_file(tokens.tokenizer_path())
    manifest = token_files.write(odd, str(tmp_path / "files"))
    got = token_files.read(manifest, with_ids=True).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order if r["doc_id"] is not None] == sorted(d for d, *_ in odd_rows if d is not None)
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:i]) for i in range(len(order))]
    want = Counter((d, tuple(tk.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, *_ in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert rows(token_files.read(manifest, [8, 12]), "doc_id") == [(12,), (8,), (8,)]
    assert token_files.round_trip(empty).count() == 0
    file = next(p for p in (tmp_path / "files").iterdir() if p.suffix == ".zst")
    damaged = bytearray(file.read_bytes())
    damaged[12] ^= 1
    (tmp_path / "bad.zst").write_bytes(bytes(damaged))
    with pytest.raises(Exception):  # noqa: B017  either checksum
        token_files.Reader(f"file://{tmp_path}/bad.zst").ids(0)


def test_long_documents_take_several_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    ids = np.arange(35, dtype="<u4").tobytes()
    with open(tmp_path / "x.zst", "wb") as out:
        w = token_files.Writer(out)
        w.add(5, ids)
        w.add(None, ids[:8])
        w.end()
    reader = token_files.Reader(f"file://{tmp_path}/x.zst")
    assert len(reader.entries) == 6 and reader.ids(0) == ids and reader.ids(1) == ids[:8] and reader.positions(5).tolist() == [0]


# Lines

def plain_dedup(data, least=50):
    """Texts by row index, by going through all windows in order: from every line on, and up to every line."""
    seen, out = {}, {}
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, data[i][2]))
    for i in order:
        lines = (data[i][1] or "").split("\n")
        real = [(k, s.strip(" \t\n\x0b\x0c\r")) for k, s in enumerate(lines) if s.strip(" \t\n\x0b\x0c\r")]
        size = [len(s.encode().split()) for _, s in real]
        wins = set()
        for a in range(len(real)):
            wins |= {(a, b) for b in range(a, len(real)) if sum(size[a : b + 1]) >= least and sum(size[a:b]) < least}
            wins |= {(b, a) for b in range(a + 1) if sum(size[b : a + 1]) >= least and sum(size[b + 1 : a + 1]) < least}
        gone, me = set(), (data[i][0], data[i][2])
        for a, b in sorted(wins):
            own, first, last = seen.setdefault(tuple(s for _, s in real[a : b + 1]), (me, real[a][0], real[b][0]))
            if (own, first) != (me, real[a][0]):
                gone |= set(range(real[a][0] if own != me else max(real[a][0], last + 1), real[b][0] + 1))
        out[i] = "\n".join(s for k, s in enumerate(lines) if k not in gone) if data[i][1] is not None else None
    return out


def test_line_dedup_equals_all_windows(spark, odd, sf):
    big = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    docs = odd.select("doc_id", "text").unionByName(big)
    data = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))))).collect()]
    want = plain_dedup(data)
    got = line_dedup.dedup(docs.withColumn("row", F.lit(1)).withColumn("n_lines", F.lit("x")))
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_deleted_lines"]
    assert rows(got, "doc_id", "text") == sorted(((data[i][0], t) for i, t in want.items()), key=repr)
    assert got.agg(F.sum("n_deleted_lines")).first()[0] > 20


def plain_runs(data, least=50):
    """Texts without the lines of any run of ``least`` words that stood earlier, found by comparing all pairs of places."""
    order = sorted(range(len(data)), key=lambda i: data[i][0])
    lines = {i: data[i][1].split("\n") for i in order}
    gone = {i: set() for i in order}
    places = [(i, k) for i in order for k in range(len(lines[i]))]
    for x, (i, a) in enumerate(places):
        for j, b in places[x + 1 :]:
            if a and b and lines[i][a - 1] == lines[j][b - 1]:
                continue  # inside a longer run
            n = 0
            while a + n < len(lines[i]) and b + n < len(lines[j]) and lines[i][a + n] == lines[j][b + n] and (i != j or a + n < b):
                n += 1
            if sum(len(t.split()) for t in lines[j][b : b + n]) >= least:
                gone[j] |= set(range(b, b + n))
    return {data[i][0]: "\n".join(t for k, t in enumerate(lines[i]) if k not in gone[i]) for i in order}


def test_runs_go_up_to_both_ends(spark):
    r = random.Random(4)
    line = {k: prose(300 + k, r.choice([3, 8, 20, 30, 60])) for k in range(40)}
    pool = [[line[k] for k in range(a, a + 8)] for a in range(0, 40, 8)]
    data = [(0, "\n".join([prose(400, 60), prose(401, 30)])), (1, "\n".join([prose(402, 9), prose(400, 60), prose(401, 30), prose(403, 9)]))]
    for d in range(2, 30):
        run = r.choice(pool)
        a, b = sorted(r.sample(range(9), 2))
        data.append((d, "\n".join([prose(500 + d, 7), *run[a:b], prose(600 + d, 7)])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = dict(rows(line_dedup.dedup(docs), "doc_id", "text"))
    assert got == plain_runs(data)
    assert got[1] == "\n".join([prose(402, 9), prose(403, 9)])


# Token counts

def test_counts_equal_the_tokenizer(spark, odd, odd_rows):
    pieces = token_counts.vocabulary(tokens.tokenizer_path(token_counts.PIECES))
    tk = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    tk.pre_tokenizer = pre_tokenizers.Metaspace()
    want = sorted(((d, len(e.ids), e.ids.count(0)) for d, e in ((d, tk.encode(t or "")) for d, t, *_ in odd_rows)), key=repr)
    assert rows(token_counts.counted(odd), "doc_id", "n_pieces", "n_unknown") == want


def test_ties_follow_the_tokenizer():
    r = random.Random(3)
    for _ in range(150):
        texts = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(8)}
        pieces = [("<unk>", -1.0), *((p, r.choice([-1.0, -2.0, -3.0])) for p in texts)]
        tk = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        tk.pre_tokenizer = pre_tokenizers.Metaspace()
        counter = token_counts.PieceCounter(pieces)
        for _ in range(20):
            text = "".join(r.choice("aabbc ") for _ in range(r.randint(0, 12)))
            ids = tk.encode(text).ids
            assert counter.text(text)[1:] == (len(ids), ids.count(0))


# Benchmark

def test_masks_find_every_allowed_substitution():
    for size in range(13, 21):
        allowed = size - math.ceil(size * decontaminate.AGREE / 100)
        hits = [sum(1 << (s + o) for o in m) for m in decontaminate.MASKS for s in range(size - m[-1])]
        for changed in combinations(range(size), allowed):
            bad = sum(1 << c for c in changed)
            assert any(not h & bad for h in hits), (size, changed)


def test_short_masks_find_every_allowed_substitution():
    for size in range(1, 13):
        masks = decontaminate.short_masks(size)
        allowed = size - math.ceil(size * decontaminate.AGREE / 100)
        assert all(max(m) < size and len(m) >= (size + 1) // 2 for m in masks)
        for changed in combinations(range(size), allowed):
            assert any(not set(m) & set(changed) for m in masks), (size, changed)


def test_short_items_equal_brute_force(spark):
    r = random.Random(9)
    items = [(i, prose(900 + i, i)) for i in range(1, 13)] + [(20, prose(950, 8)), (21, prose(951, 30))]
    docs = []
    for k in range(120):
        own = items[r.randrange(len(items))][1].split()
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(len(own))] = "changed"
        docs.append((k, f"{prose(100 + k, r.randrange(0, 30))} {' '.join(own)} {prose(200 + k, r.randrange(0, 30))}"))
    docs += [(500, items[5][1]), (501, items[11][1]), (502, None)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_overlaps(docs, items) and len({i for _, i in got}) == len(items)


def plain_overlaps(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    first = {}
    for i, t in items:
        if words(t):
            first[tuple(words(t))] = min(first.get(tuple(words(t)), i), i)
    found = set()
    for d, t in docs:
        w = words(t)
        for b, i in first.items():
            n = min(20, len(b))
            for k in range(len(b) - n + 1):
                for a in range(len(w) - n + 1):
                    if 100 * sum(x == y for x, y in zip(w[a : a + n], b[k : k + n])) >= 80 * n:
                        found.add((d, i))
    return found


def test_overlaps_equal_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(50 + i, 14 + 3 * i)) for i in range(6)] + [(6, prose(50, 14)), (7, None), (8, ""), (9, None)]
    docs = [(0, None), (1, ""), (2, prose(70, 200))]
    for k in range(60):
        own = items[r.randrange(6)][1].split()
        for _ in range(r.randrange(0, 6)):
            own[r.randrange(len(own))] = "changed"
        cut = own[: r.randrange(8, len(own) + 1)]
        docs.append((3 + k, f"{prose(100 + k, r.randrange(0, 40))} {' '.join(cut)} {prose(200 + k, r.randrange(0, 40))}"))
    docs += [docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == plain_overlaps(docs, items) and len(got) > 15
    clean = decontaminate.clean(df, bench)
    assert rows(clean, "doc_id") == sorted(((d,) for d, _ in docs if d not in {x for x, _ in got}), key=repr) and clean.columns == df.columns
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_a_large_benchmark_is_looked_up_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(50, 40)), (2, prose(51, 40)), (3, prose(99, 40))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, prose(50, 40)), (2, prose(51, 40))], "item_id long, text string")
    whole = rows(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "n_equal")
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", 50)
    assert rows(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "n_equal") == whole and len(whole) == 2


def test_a_large_benchmark_broadcasts_a_filter_and_reads_documents_once(spark, monkeypatch):
    items = [(i, prose(400 + i, 12 + i)) for i in range(30)]
    docs = [(k, f"{prose(500 + k, 9 * k)} {items[k % 30][1]} {prose(600 + k, 5)}") for k in range(40)] + [(41, prose(700, 300)), (42, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SEEDS_AT_ONCE", 20)
    monkeypatch.setattr(decontaminate, "BLOCKS", 3)
    found = decontaminate.overlaps(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == plain_overlaps(docs, items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    tests = decontaminate.items(bench)
    seeds = decontaminate.item_seeds(tests, decontaminate.short_sizes(tests)).cache()
    looked = seeds.select(F.col("seed").alias("looked")).unionAll(spark.range(9000).select(F.xxhash64("id")))
    left = decontaminate.screened(looked, seeds, seeds.count())
    assert left.join(seeds, F.col("looked") == F.col("seed"), "left_semi").count() == seeds.count() and left.count() < 9000


# Quality rules

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(w)
    covered = {i + k for i, x in enumerate(w) if n[x] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_plain_ones(spark, odd, odd_rows, sf):
    r = random.Random(4)
    texts = [t for _, t, *_ in odd_rows if len(t or "") < 50_000] + [" ".join(r.choice("ab#") for _ in range(r.randrange(60))) for _ in range(60)]
    texts += [x[0] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert [quality.text_counts(t)[:5] for t in texts] == [plain_counts(t) for t in texts]


def test_binomial_bound_is_exact():
    for n, k, p in ((20, 0, 0.1), (50, 3, 0.05), (200, 10, 0.02)):
        assert math.isclose(quality.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_cutoff_stops_where_the_risk_is_not_refuted():
    assert quality.choose([0, 0, 60, 940], [50, 30, 20, 0], 0.02, 0.01) == 1
    assert quality.choose([0, 0, 0, 100], [50, 30, 20, 0], 0.02, 0.01) is None  # too few labels to say
    assert quality.choose([0, 0, 0, 1000], [0, 0, 0, 10], 0.02, 0.01) is None  # nothing gained


def test_rejections_stay_below_the_risk(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(3160):
        bad = i % 4 == 0
        words = [w + ("$$$" if bad and r.random() < 0.8 else "#" if r.random() < 0.004 else "") for w in prose(i, 60).split()]
        docs.append((i, " ".join(words), "fr" if i >= 3000 else "en" if i % 3 else None))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (5, None), (99999, 1), (4, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judged(df, lab).where(~F.col("base_failed")).groupBy("stratum", (F.col("doc_id") % 4 == 0).alias("bad")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {(r["stratum"], r["bad"]): r["kept"] for r in got}
    for lang in ("en", ""):
        assert share[lang, False] > 0.98 and share[lang, True] < 0.02
    assert share["fr", False] == share["fr", True] == 1  # too few labels to allow a rung
    kept = quality.keep(df.withColumn("kept", F.lit("x")), lab)
    assert kept.columns == ["doc_id", "text", "lang", "kept"] and kept.count() == quality.judged(df, lab).where("kept").count()


def test_levels_are_shared_by_holm():
    assert quality.shared_level([], 4, 0.05) == 0.0125 and quality.shared_level([0.2], 1, 0.05) == 0.05
    assert quality.shared_level([0.001, 0.016], 4, 0.05) == 0.05 / 2 and quality.shared_level([0.001, 0.02], 4, 0.05) == 0.05 / 3
    assert quality.shared_level([0.0, 0.0], 2, 0.05) == 0.05
    assert quality.least_labels(0.02, 0.05 / 4) == 217 and quality.binomial_tail(0, 217, 0.02) <= 0.0125 < quality.binomial_tail(0, 216, 0.02)


def test_the_limit_is_kept_in_simulations():
    """Three strata whose second rung just breaks the risk: some stratum uses it in at most the level's share of draws."""
    r = np.random.default_rng(11)
    broken = used = 0
    for _ in range(600):
        good = [r.multinomial(n, [0.004, 0.017, 0.979]).tolist() for n in (230, 500, 2000)]
        able = [quality.whole_ladder(g, 0.02) for g in good]
        each = quality.shared_level(able, 3, 0.05)
        chosen = [quality.choose(g, [30, 70, 0], 0.02, each) for g in good]
        broken += any(c == 1 for c in chosen)
        used += sum(c == 0 for c in chosen)
    assert broken <= 0.05 * 600 + 3 * (600 * 0.05 * 0.95) ** 0.5 and used > 600


def test_every_language_of_the_table_has_a_cutoff(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["stratum"]: r["cutoff"] for r in quality.cutoffs(quality.written(quality.measured(docs), "counts"), labels).collect()}
    assert set(got) == {"en", "de", "fr", "es"} and all(c is not None for c in got.values())


def test_quality_without_labels(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judged(odd, none)
    assert got.count() == len(odd_rows) and got.where("kept = base_failed").count() == 0
    assert quality.keep(empty, none).count() == 0 and quality.judged(empty, none).count() == 0


# Licences

@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), sample=800)


def test_licences_are_found_confirmed_and_told_apart(spark, odd, model, sf):
    made = [
        (1, f"{prose(1, 30)}\nReleased under the MIT License.\n{prose(2, 30)}"), (2, "released under the  mit license"), (3, "Licensed under the Zebrafish License."),
        (4, prose(3, 200)), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "This library is licensed under the GNU Lesser General Public License, version 3."), (7, None), (8, ""),
        (9, "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0."), (None, "Licensed under CC BY 4.0."), (10, "We may use the general terms of this library in version 3."),
    ]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("w", F.lit("x"))
    got = rows(licences.scan(df, model), "doc_id", "paragraph", "family", "confirmed")
    want = [(1, 1, "MIT", True), (2, 0, "MIT", True), (5, 0, "GPL-3.0", True), (6, 0, "LGPL-3.0", True), (9, 0, "CC-BY-NC-4.0", True), (9, 2, "Apache-2.0", True), (None, 0, "CC-BY-4.0", True)]
    assert [r for r in got if r[3]] == sorted(want, key=repr)
    assert (3, 0, "unknown", False) in got and not {r[0] for r in got} & {4, 7, 8}
    assert licences.scan(odd, model).count() == 0 and licences.scan(odd.limit(0), model).count() == 0


def test_licences_in_empty_and_tiny_tables(spark, empty):
    assert licences.scan(empty).count() == 0
    tiny = spark.createDataFrame([(1, "Released under the MIT License."), (2, prose(1, 30)), (3, None), (4, "Licensed under the Zebrafish License.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licences.scan(tiny).collect()}
    assert got == {1: ("MIT", True), 4: ("unknown", False)}


def test_the_screen_loses_nothing(spark, model, sf):
    """Every paragraph that the weights do not call "none" passes the screen."""
    none = model.classes.index("none")
    held = [t for t, _, _ in licences.examples()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        held += r["text"].split("\n")
    screen = re.compile(licences._screen(model))
    for text in held:
        raw = [sum(model.weights[g][k] for g in licences.grams_of(text) if g in model.weights) + b for k, b in enumerate(model.intercepts)]
        assert max(range(len(raw)), key=raw.__getitem__) == none or screen.search(text.lower()), text
