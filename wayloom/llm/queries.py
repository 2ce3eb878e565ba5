"""Queries op1..op10 over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import format_chat, read_back, with_probe
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .jaccard_join import jaccard_join
from .language_id import language_id
from .pii import find_pii
from .sentencepiece_codec import sentencepiece
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), l AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM g) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, s + o AS i FROM l, (SELECT unnest(range(0, 20)) AS o)
), x AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, m, array_to_string(w[s:s + m - 1], ' ') AS k
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM b)
), dw AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)
), h AS (
  SELECT DISTINCT doc_id, m, s, item_id FROM dw JOIN bw USING (m, k)
), n AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM (SELECT DISTINCT doc_id, m, s FROM h)) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard_join(_table(spark, sf_dir, "documents")).drop("class_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""

def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score."""
    return find_pii(_table(spark, sf_dir, "documents")).drop("found")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_back(format_chat(with_probe(_table(spark, sf_dir, "conversations"))))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), e AS (
  SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) + 4 AS k, row_number() OVER o AS i,
    4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) END
    + 2 + length(replace(replace(replace(t, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS n
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, t)
), s AS (
  SELECT conv_id, k AS sk, n AS sn FROM e WHERE i = 1 AND role = 'system'
), p AS (
  SELECT e.*, sn, greatest(1, 384 - coalesce(sk, 0)) AS room, CAST(coalesce(sum(k) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM e LEFT JOIN s USING (conv_id)
), w AS (
  SELECT *, before // room AS w, before >= (before // room + 1) * room - 128 AND NOT (i = 1 AND sn IS NOT NULL) AS again FROM p
), f AS (
  SELECT conv_id, CAST(sum(n) + coalesce(sum(n) FILTER (again AND (conv_id, w + 1) IN (SELECT conv_id, w FROM w)), 0) + coalesce(max(sn), 0) * (count(DISTINCT w) - 1) AS BIGINT) AS formatted_chars
  FROM w GROUP BY conv_id
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, max(formatted_chars) AS formatted_chars
FROM w JOIN f USING (conv_id) GROUP BY conv_id
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language_id(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_extract(_table(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, text_sha256 (of what the ids decode to), round_trip, ids."""
    return sentencepiece(_table(spark, sf_dir, "documents"), columns=("ids",))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, spans."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _pii_spans(kind: int, pattern: str) -> str:
    """SQL of a kind's matches with their places: the gaps between matches give them."""
    return f"""SELECT id, t, {kind} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'body': m[i],
      's': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}})) AS x
    FROM (SELECT id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)"""


_PII = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    r"[0-9](?:[ -]?[0-9])+",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
)
OP9_SQL = (
    "WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), p AS ("
    + " UNION ALL ".join(_pii_spans(k, p) for k, p in enumerate(_PII))
    + r"""), q AS (
  SELECT id, rank, x.s AS s, x.s + length(x.body) AS e, x.body AS b, regexp_replace(x.body, '[^0-9]', '', 'g') AS n, replace(x.body, ' ', '') AS i,
    lower(substr(t, greatest(x.s - 40, 0) + 1, x.s - greatest(x.s - 40, 0))) AS near FROM p
), v AS (
  SELECT *, CASE rank WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(b, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(ltrim(o, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(n, length(n) + 1 - k, 1) AS INTEGER)
      ELSE CAST(substr(n, length(n) + 1 - k, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(n, length(n) + 1 - k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 3 THEN length(n) BETWEEN 9 AND 15
    WHEN 4 THEN length(i) BETWEEN 15 AND 34 AND list_reduce(string_split(substr(i, 5) || substr(i, 1, 4), ''),
      lambda a, c: CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ord(c) - 48) % 97 ELSE (a * 100 + ord(c) - 55) % 97 END, 0) = 1
    ELSE regexp_matches(near, 'ssn|social|security') END AS ok,
    least(1e0, CASE rank WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.5e0 WHEN 4 THEN 0.9e0 ELSE 0.3e0 END
      + CASE WHEN regexp_matches(near, CASE rank WHEN 0 THEN 'mail|contact|write' WHEN 1 THEN '(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server' WHEN 2 THEN 'card|visa|credit|pay'
        WHEN 3 THEN 'phone|call|tel|mobile|fax' WHEN 4 THEN 'iban|account|bank' ELSE 'ssn|social|security' END) THEN 0.3e0 ELSE 0e0 END) AS score,
    ['email', 'ip', 'card', 'phone', 'iban', 'ssn'][rank + 1] || ':' || s || ':' || e AS said FROM q
), f AS (
  SELECT id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
    string_agg(said, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base, string_agg(said, ',' ORDER BY s, rank, e) AS spans, max(score) AS max_score FROM v WHERE ok GROUP BY id
)
SELECT d.id AS doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(max_score, 0) AS max_score FROM d LEFT JOIN f USING (id)
"""
)

QUERIES = {
    "op1_substring_dedup": op1,
    "op2_chat_format": op2,
    "op3_language_id": op3,
    "op4_html_extract": op4,
    "op5_sentencepiece": op5,
    "op6_toxicity": op6,
    "op7_exact_dedup": op7,
    "op8_decontaminate": op8,
    "op9_pii": op9,
    "op10_jaccard_join": op10,
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_pii": OP9_SQL, "op10_jaccard_join": OP10_SQL}
