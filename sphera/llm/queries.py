"""Registry of this subpackage's queries; each applies one operator to its whole table."""

from sphera.llm import html_text, jaccard_join, langid, matroska, mixing, passages, pieces, simhash, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_mixing": mixing.query,
        "op4_html_text": html_text.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_media": matroska.query,
        "op7_langid": langid.query,
        "op8_toxicity": toxicity.query,
        "op9_pieces": pieces.query,
        "op10_passages": passages.query,
    }


#: Positions of 200-byte strings that occur more than once, the runs that they cover, and what is left.
OP2 = """
WITH whole AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS h FROM documents
), windows AS (SELECT rid, unnest(range(octet_length(h) - 199)) AS p, h FROM whole WHERE octet_length(h) >= 200
), counted AS (SELECT rid, p, count(*) OVER (PARTITION BY md5(array_slice(h, p + 1, p + 200))) AS n FROM windows
), places AS (SELECT rid, p, p - lag(p) OVER (PARTITION BY rid ORDER BY p) AS gap FROM counted WHERE n > 1
), numbered AS (SELECT rid, p, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS run FROM places
), spans AS (SELECT rid, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY rid, run
), kept AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans
), parts AS (
  SELECT k.rid, string_agg(hex(array_slice(w.h, k.before + 1, k.a)), '' ORDER BY k.a) AS head, sum(k.b - k.a) AS removed, count(*) AS n, max(k.b) AS last
  FROM kept k JOIN whole w USING (rid) GROUP BY k.rid
)
SELECT w.doc_id, CAST(octet_length(w.h) AS BIGINT) AS n_bytes, CAST(coalesce(p.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(p.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(p.head, '') || hex(array_slice(w.h, coalesce(p.last, 0) + 1, octet_length(w.h))))) AS kept_sha256
FROM whole w LEFT JOIN parts p USING (rid)
"""

#: Shingle sets, their links, and who can be reached by links.
OP5 = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM split
), sizes AS (SELECT rid, doc_id, len(s) AS n, s FROM sets
), keys AS (SELECT rid, n, unnest(s) AS k FROM sizes
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM keys a JOIN keys b ON a.k = b.k AND a.rid <> b.rid AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT rid, rid FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sizes z JOIN reach r ON r.a = z.rid JOIN sizes o ON o.rid = r.b GROUP BY z.rid, z.doc_id, z.n
"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that DuckDB can express; the others are held against brute force, the library or held-out rows in tests."""
    return {"op2_suffix_dedup": OP2, "op5_jaccard_join": OP5}
