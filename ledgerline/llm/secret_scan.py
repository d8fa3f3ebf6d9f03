"""Secret scans over a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that every match fulfils: literals are taken
through concatenation, alternation and optional parts as far as they are certain. One pass over a text finds the queried
trigrams (its postings); postings are intersected per document, and only the surviving pairs of rule and document are verified
by the expression itself. A rule whose expression makes no trigram certain (a run of hex digits) scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _constants as sre
from re._parser import parse as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body


@dataclass(frozen=True)
class Rule:
    """``measured`` is the capture group that needs ``least`` characters; matches that are shorter are dropped after matching,
    as they still take up their characters. The pattern must mean the same to Java and to Python's parser of patterns."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", measured=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # One class of characters: asking for 32 is the same as taking every run and dropping the short ones.
    Rule("hex", r"[0-9a-f]{32,}"),
)

#: Spellings a part of a pattern may have before it counts as unknown, and trigrams of one text's posting mask.
SPELLINGS, MASK = 16, 63

#: A trigram and whether it is looked for in the lower-cased text.
Gram = tuple[bool, str]


@dataclass(frozen=True)
class Part:
    """What is certain about the matches of a part of a pattern.

    ``exact``: all its spellings, each character with whether its case is free; None when there are others. ``sets``: what
    every match contains besides, as alternatives of which one holds with all its trigrams; one empty set says nothing.
    """

    exact: frozenset[tuple[Gram, ...]] | None
    sets: frozenset[frozenset[Gram]] = frozenset([frozenset()])


def _trigrams(spelling: tuple[Gram, ...]) -> frozenset[Gram]:
    """The trigrams of a spelling; one with a character of free case is looked for in lower case throughout."""
    grams = []
    for three in zip(spelling, spelling[1:], spelling[2:]):
        fold = any(free for free, _ in three)
        grams.append((fold, "".join(c.lower() if fold else c for _, c in three)))
    return frozenset(grams)


def _least(sets: frozenset[frozenset[Gram]]) -> frozenset[frozenset[Gram]]:
    """Without alternatives that ask for more than another one."""
    return frozenset(a for a in sets if not any(b < a for b in sets))


def _any(a: frozenset, b: frozenset) -> frozenset:
    return _least(a | b)


def _all(a: frozenset, b: frozenset) -> frozenset:
    both = _least(frozenset(x | y for x in a for y in b))
    return both if len(both) <= SPELLINGS else min(a, b, key=len)


def _certain(part: Part) -> frozenset[frozenset[Gram]]:
    """All that is known of a part, as alternatives of trigrams."""
    return part.sets if part.exact is None else _all(part.sets, _least(frozenset(_trigrams(e) for e in part.exact)))


UNKNOWN = Part(None)


def _one_of(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and len(together := frozenset().union(*[p.exact for p in parts])) <= SPELLINGS:
        return Part(together)
    return Part(None, _least(frozenset().union(*[_certain(p) for p in parts])))


def _in_turn(parts: list[Part]) -> Part:
    """Neighbours with known spellings are joined before their trigrams are taken, so trigrams cross their border."""
    sets, run, whole = frozenset([frozenset()]), frozenset([()]), True
    for p in parts:
        joined = None if p.exact is None else frozenset(a + b for a in run for b in p.exact)
        sets = _all(sets, p.sets)
        if joined is not None and len(joined) <= SPELLINGS:
            run = joined
        else:
            sets, whole = _all(sets, _certain(Part(run))), False
            run = frozenset([()]) if p.exact is None else p.exact
    return Part(run, sets) if whole else Part(None, _all(sets, _certain(Part(run))))


def _part(tree, fold: bool) -> Part:
    """What is certain about the matches of a parsed pattern; whatever is not understood is unknown, which is always safe."""
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            # Outside ASCII the two languages fold case differently.
            parts.append(UNKNOWN if arg > 127 else Part(frozenset([((fold, chr(arg)),)])))
        elif op is sre.IN and len(arg) <= SPELLINGS and all(o is sre.LITERAL and v <= 127 for o, v in arg):
            parts.append(Part(frozenset(((fold, chr(v)),) for _, v in arg)))
        elif op is sre.SUBPATTERN:
            parts.append(_part(arg[3], (fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE)) and not arg[2] & sre.SRE_FLAG_IGNORECASE))
        elif op is sre.BRANCH:
            parts.append(_one_of([_part(t, fold) for t in arg[1]]))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_part(arg, fold))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg[0], arg[1], _part(arg[2], fold)
            if (low, high) == (0, 1):
                parts.append(_one_of([inner, Part(frozenset([()]))]))
            elif low == 0:
                parts.append(UNKNOWN)
            else:
                # At least ``low`` times; some four suffice for every trigram that a repetition makes certain.
                parts += [inner] * min(low, 4)
                if high != low or low > 4:
                    parts.append(UNKNOWN)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            parts.append(Part(frozenset([()])))  # takes up no character
        else:
            parts.append(UNKNOWN)
    return _in_turn(parts)


def trigram_query(pattern: str) -> frozenset[frozenset[Gram]]:
    """The alternatives of a pattern's Boolean query, each a set of (folded, trigram) that must all occur in a text with a match."""
    tree = sre_parse(pattern)
    return _certain(_part(tree, bool(tree.state.flags & sre.SRE_FLAG_IGNORECASE)))


def queries(rules: tuple[Rule, ...] = RULES) -> dict[str, list[frozenset[Gram]]]:
    """Per rule the alternatives of its query; rules without mandatory trigrams are not in it."""
    derived = {r.kind: sorted(trigram_query(r.pattern), key=sorted) for r in rules}
    return {k: q for k, q in derived.items() if all(q)}


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[Gram]:
    return sorted({g for alternatives in queries(rules).values() for a in alternatives for g in a})


def _keyed(docs: DataFrame) -> DataFrame:
    text = body(docs)
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("digest"), text.alias("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram (its number in the vocabulary), doc_id, digest: the posting lists of all queried trigrams over whole texts."""
    keyed = _keyed(docs)
    known = vocabulary(rules)
    lists = []
    for fold in sorted({f for f, _ in known}):
        # One pass that looks ahead at every character; the first characters are asked first.
        grams = {g: i for i, (f, g) in enumerate(known) if f == fold}
        heads = "".join(f"\\x{ord(c):02x}" for c in sorted({g[0] for g in grams}))
        spelled = "|".join("".join(f"\\x{ord(c):02x}" for c in g) for g in grams)
        seen = F.array_distinct(F.regexp_extract_all(F.lower("text") if fold else F.col("text"), F.lit(f"(?=[{heads}])(?=({spelled}))"), F.lit(1)))
        number = F.create_map(*[F.lit(x) for pair in grams.items() for x in pair])
        lists.append(_numbered(seen, number))
    none = F.array().cast("array<int>")
    return keyed.select("doc_id", "digest", F.explode(F.concat(none, *lists)).alias("trigram"))


def _numbered(grams: Column, number: Column) -> Column:
    return F.transform(grams, lambda g: F.element_at(number, g))


def candidates(lists: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, digest, may (array of kinds): the documents on which the Boolean query of some rule holds, and those rules.

    Each document's postings meet as the bits of numbers (partial sums before the shuffle), and the query is a mask on them.
    """
    place = {g: i for i, g in enumerate(vocabulary(rules))}
    words = range(len(place) // MASK + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % MASK)
    bits = lists.groupBy("doc_id", "digest").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / MASK) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in words])

    def held(alternative: frozenset[Gram]) -> Column:
        masks = {k: sum(1 << place[g] % MASK for g in alternative if place[g] // MASK == k) for k in words}
        return reduce(and_, [F.col(f"bits{k}").bitwiseAND(F.lit(m)) == m for k, m in masks.items() if m])

    # One array rather than a flag per rule: the optimizer's constraints over many flags grow exponentially.
    hold = [F.when(reduce(or_, [held(a) for a in alternatives]), F.lit(kind)) for kind, alternatives in queries(rules).items()]
    may = F.array_compact(F.array(*hold).cast("array<string>"))
    return bits.select("doc_id", "digest", may.alias("may")).where(F.size("may") > 0)


def found(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points: the leftmost non-overlapping matches of the rule that are long enough.

    What lies between matches (split) and the matches themselves (extract) alternate, so running sums of their lengths are
    the places.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.measured)) if rule.measured else whole
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("all"))
    walked = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("part")),
        empty,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["part"].alias("size")))).alias("all"),
        ),
    )
    return F.transform(F.filter(walked["all"], lambda x: x["size"] >= rule.least), lambda x: F.struct(x["start"], x["end"]))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of start, end, kind, ordered by start and by the rules' order), kinds.

    Whole texts are scanned; a null text counts as empty and has no spans. Rows equal in id and text share their postings and
    get the same spans each. Null ids are joined as equal. An empty table gives no rows. Only doc_id and text are read.
    """
    may = candidates(postings(docs, rules), rules).withColumnsRenamed({"doc_id": "may_id", "digest": "may_digest"})
    joined = _keyed(docs).join(may, F.col("doc_id").eqNullSafe(F.col("may_id")) & (F.col("digest") == F.col("may_digest")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    indexed = queries(rules)
    each = []
    for i, r in enumerate(rules):
        asked = F.coalesce(F.array_contains("may", r.kind), F.lit(False)) if r.kind in indexed else F.col("text").rlike(r.pattern)
        spans = F.when(asked, found(F.col("text"), r)).otherwise(none)
        each.append(_named(spans, i, r.kind))
    return joined.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))
