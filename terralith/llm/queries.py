"""Queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import shared_folder, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op3_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeat_dedup

    return repeat_dedup(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), shared_folder(spark, "token-cache"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_repeat_dedup": op3_repeat_dedup,
    "op4_ring_shards": op4_ring_shards,
    "op5_pfair_mix": op5_pfair_mix,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dups": op7_near_dups,
    "op8_decontaminate": op8_decontaminate,
    "op9_page_text": op9_page_text,
    "op10_token_counts": op10_token_counts,
}

#: A-Z lower-cased, other letters left alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = r"""
WITH lines AS (
  SELECT doc_id, pos, line, KEY AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
keys AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> keys.last_doc, false) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""".replace("KEY", _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"))

_WORD_8 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOWER, 'WORD') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOWER, 'WORD') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT p.doc_id, p.i, p.n, windows.item FROM places p JOIN windows ON p.n = windows.n AND p.win = windows.win),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("LOWER", _LOWER.format("coalesce(text, '')")).replace("WORD", _WORD_8)

_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, win FROM win GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (
  SELECT doc_id, CAST(count(DISTINCT j) AS BIGINT) AS n_repeat_words
  FROM (SELECT win.doc_id, unnest(range(win.i, win.i + 5)) AS j FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.win = twice.win) GROUP BY doc_id),
a AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM m LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END AS bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, CAST(bits AS BIGINT) AS fail_bits,
       bits & 3 <> 0 AS base_failed, bits = 0 AS kept
FROM b
"""

_WORD = _LOWER.format("coalesce(text, '')")


def _op2() -> str:
    from .license_scan import PHRASES, TEMPLATES, template_words

    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {quoted(dict.fromkeys(template_words(t)))}, {len(template_words(t))})" for label, t in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_WORD}, '{_WORD_8}') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
templates(label, t, size) AS (VALUES {templates}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, phrases) WHERE w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
likely AS (SELECT doc_id, w, label, t, size FROM (SELECT doc_id, w, list_distinct(w) AS k FROM d), templates WHERE len(list_intersect(t, k)) >= ceil(0.8 * len(t) - 1e-9)),
own AS (SELECT doc_id, label, t, size, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely) WHERE list_contains(t, w[i])),
windows AS (SELECT a.doc_id, a.label, a.i, len(any_value(a.t)) AS n, count(DISTINCT b.word) AS common FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.size GROUP BY 1, 2, 3),
held AS (SELECT doc_id, label, max(common) / any_value(n) AS share FROM windows GROUP BY doc_id, label HAVING max(common) >= ceil(0.8 * any_value(n) - 1e-9)),
found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM held) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM held GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_OP5 = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS s, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM documents GROUP BY 1),
weights AS (SELECT s, 1 + (1000 * root) // (SELECT sum(root) FROM counts) AS weight FROM counts),
whole AS (SELECT list(CAST(weight AS BIGINT) ORDER BY s) AS w, CAST(sum(weight) AS BIGINT) AS q FROM weights),
slots AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, w, q FROM whole
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p, w, q
  FROM (SELECT *, list_sort(list_filter(list_transform(done, lambda d, i: CASE WHEN (d * q) // w[i] <= t AND d < w[i] THEN {'due': ((d + 1) * q + w[i] - 1) // w[i], 'i': i} END), lambda x: x IS NOT NULL))[1].i AS p FROM slots WHERE t < q)),
turns AS (SELECT pick, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM slots WHERE t > 0),
named AS (SELECT s, weight, row_number() OVER (ORDER BY s) AS pick FROM weights),
places AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS idx FROM documents)
SELECT doc_id, source, CAST(weight AS BIGINT) AS mix_weight, q AS mix_total, CAST(idx // 64 AS BIGINT) AS mix_block,
       CAST((idx // 64) // weight * q + slot AS BIGINT) AS mix_slot, CAST(idx % 64 AS BIGINT) AS mix_place
FROM places JOIN named USING (s) JOIN turns ON turns.pick = named.pick AND turns.turn = (idx // 64) % weight, whole
"""

_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_slice(w, i, i + 1) END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN parts USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("LOWER", _WORD)

ORACLES: dict[str, str] = {
    "op2_license_scan": _op2(),
    "op5_pfair_mix": _OP5,
    "op7_near_dups": _OP7,
    "op6_quality_rules": _OP6,
    "op1_line_dedup": _OP1,
    "op8_decontaminate": _OP8,
}
