"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, fill_middle, licences, line_dedup, packing, periodic_runs, quality, secret_scan, sharding, simhash, token_counts, token_files
from .common import table
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_golay_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id of its near-duplicates."""
    return simhash.grouped(table(spark, sf_dir, "documents"))


@query("op2_licence_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are licence notices, with family, probability and the template's confirmation."""
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op3_virtual_slots")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to 24 shards by virtual slots, equal in bytes."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


@query("op4_trigram_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts per kind and the spans with their digest."""
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return scanned.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in secret_scan.RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


@query("op5_swap_search_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


#: The same by lists: j is the end of the shortest run of 50 words from line i on, or its start where it ends on line i; a
#: window's content is compared as text.
_LINES_SQL = r"""
WITH line AS (
    SELECT doc_id, k - 1 AS k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)
), worded AS (
    SELECT doc_id, k, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, words,
           row_number() OVER w AS i, sum(words) OVER w AS upto
    FROM line WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), doc AS (
    SELECT doc_id, list(line ORDER BY i) AS lines, list(k ORDER BY i) AS ks, list(upto ORDER BY i) AS sums FROM worded GROUP BY 1
), ended AS (
    SELECT doc_id, i, lines, ks, list_position(list_transform(sums, lambda x: x >= upto - words + 50), true) AS j FROM worded JOIN doc USING (doc_id)
    UNION
    SELECT doc_id, len(list_filter(sums, lambda x: x <= upto - 50)) + 1, lines, ks, i FROM worded JOIN doc USING (doc_id) WHERE upto >= 50
), win AS (
    SELECT doc_id, ks[i] AS first, ks[j] AS last, array_to_string(lines[i:j], chr(10)) AS content FROM ended WHERE j > 0
), origin AS (
    SELECT content, min(struct_pack(doc_id := doc_id, first := first, last := last)) AS o FROM win GROUP BY 1
), later AS (
    SELECT doc_id, CASE WHEN o.doc_id = doc_id THEN greatest(first, o.last + 1) ELSE first END AS first, last
    FROM win JOIN origin USING (content) WHERE (doc_id, first) <> (o.doc_id, o.first)
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(CAST(first AS BIGINT), CAST(last AS BIGINT))) AS k FROM later WHERE first <= last
)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_deleted_lines,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line.k) FILTER (gone.k IS NULL), '')) AS text_md5
FROM line LEFT JOIN gone USING (doc_id, k) GROUP BY 1
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@query("op6_winnowed_lines", _LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its lines that repeat a passage of 50 words or more are gone."""
    cut = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_deleted_lines", F.md5("text").alias("text_md5"))


@query("op7_seekable_frames")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op8_viterbi_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, unigram pieces and unknown pieces of every document."""
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query("op9_spaced_seeds")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item, substitutions allowed."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_risk_controlled_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with cut-offs fitted on all labels."""
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rules")


@query("op11_context_tree_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by context-tree weighting, and by the unigram base, learnt from nine documents in ten."""
    return context_tree.scored(table(spark, sf_dir, "documents"))


@query("op12_cover_lce_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, one id in ten with a planted one, and the text with one period of each left."""
    found = periodic_runs.periodic(table(spark, sf_dir, "documents"), periodic_runs.planted)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


#: The same by substrings of code points; the text is rebuilt from the output by the places of its marks.
_FIM_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS u, CAST('0x' || h[25:32] AS BIGINT) % 100 AS v FROM hashed
), formed AS (
    SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), made AS (
    SELECT *, CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || left(text, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
        ELSE '<S>' || substring(text, b + 1) || '<P>' || left(text, a) || '<M>' || substring(text, a + 1, b - a) END AS output
    FROM formed
), split AS (
    SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM made
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
           WHEN 'psm' THEN substring(output, 4, s - 4) || substring(output, m + 3) || substring(output, s + 3, m - s - 3)
           ELSE substring(output, p + 3, m - p - 3) || substring(output, m + 3) || substring(output, 4, p - 4) END) AS restored_sha256
FROM split
"""


@query("op13_counted_fill_middle", _FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two drawn code points, with digests of the output and of the text read back from it."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
