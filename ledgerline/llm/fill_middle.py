"""Fill-in-middle transformation by counted quantifiers: one match of a pattern made for the row cuts a text in three.

A text is a sequence of units (code points, words, lines: any expression that tiles a text). ``regexp_count`` gives their
number n, a hash of the id two cut places a <= b, and the row's own pattern ``(unit{a}+)(unit{b-a}+)(rest)`` is matched and
replaced once, so prefix, middle and suffix come out in the order of the row's form. The counted groups are possessive: they
are matched by a loop that keeps no way back, so neither stack nor time grows beyond the text's length.

Everything is an expression of one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body

#: Units that tile a text.
CODE_POINT = r"(?s:.)"
WORD_UNIT = r"(?s:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"
LINE_UNIT = r"(?s:[^\n]*+\n|[^\n]++\z)"

#: Units counted by one match, so that the list of matches stays short for very long texts.
AT_ONCE = 1000


@dataclass(frozen=True)
class Markers:
    """The three marks. Each differs from the others and begins with a character that it holds only once, so that no mark can arise across the edge of a part."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if not all(marks) or len({m[0] for m in marks}) > 1 or any(m.count(m[0]) > 1 for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("marks share a first character that they hold once, and none begins another")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def _inserted(mark: str) -> str:
    """A mark in a replacement, where backslash and dollar have a meaning."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units follow one another from the start of a text: whole thousands first, then what is left."""
    many = F.regexp_count(text, F.lit(rf"\G(?:{unit}){{{AT_ONCE}}}+")) * AT_ONCE
    rest = F.regexp_replace(text, F.concat(F.lit(rf"\A(?:{unit}){{"), many.cast("string"), F.lit("}+")), F.lit(""))
    return (many + F.regexp_count(rest, F.lit(rf"\G(?:{unit})"))).cast("long")


def draws(doc_id: Column, seed: str = "1") -> Column:
    """Four unsigned 32-bit numbers of an id, the first four groups of the hash of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, unit: str = CODE_POINT, markers: Markers = Markers(), fim_percent: int = 90, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain) and output.

    ``fim_percent`` of the ids are transformed, ``spm_percent`` of those with the suffix first. Prefix and middle end after
    two drawn places from 0 to n; the suffix is the rest, also what no unit covers. Empty and null texts and texts that hold
    a mark stay plain; a null text gives an empty output. The draw depends on the id alone, so rows equal in id are cut
    at equal places if equally long. Columns named as the results are replaced, all others stay. Empty tables stay empty.
    """
    own = [c for c in docs.columns if c not in ("n", "form", "prefix_units", "middle_units", "output")]
    row = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), body(docs).alias("text"), draws(docs["doc_id"], seed).alias("h"))
    counted = row.withColumn("n", units(F.col("text"), unit))
    marked = F.greatest(*[F.contains("text", F.lit(m)) for m in (markers.prefix, markers.suffix, markers.middle)])
    at = lambda k: F.col("h")[k] % (F.col("n") + 1)
    placed = counted.select(
        "row", "text", "n", F.least(at(0), at(1)).alias("a"), F.greatest(at(0), at(1)).alias("b"),
        F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= fim_percent), "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    counted_group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), counted_group(F.col("a")), counted_group(F.col("b") - F.col("a")), F.lit(r"((?s:.*+))\z"))
    p, s, m = _inserted(markers.prefix), _inserted(markers.suffix), _inserted(markers.middle)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    moved = F.col("form") != "plain"
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in own], "n", "form",
        F.when(moved, F.col("a")).alias("prefix_units"), F.when(moved, F.col("b") - F.col("a")).alias("middle_units"), output.alias("output"),
    )


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text of an output and its form, read back from the marks."""
    p, s, m = map(_quoted, (markers.prefix, markers.suffix, markers.middle))
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
