"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, mixing, neardup, pii, quality, search, substrings, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_search": search.op2_search,
        "op3_pii": pii.op3_pii,
        "op4_warc": warc.op4_warc,
        "op5_substrings": substrings.op5_substrings,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_neardup": neardup.op7_neardup,
        "op8_quality": quality.op8_quality,
        "op9_decontam": decontam.op9_decontam,
        "op10_mixing": mixing.op10_mixing,
    }


#: A-Z become a-z, nothing else does.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SEARCH = f"""
WITH d AS (SELECT doc_id, {_ALNUM} w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*)::DOUBLE n, greatest(sum(len(w)), 1)::DOUBLE / count(*) average FROM d),
t AS (SELECT doc_id, len(w) size, x, count(*)::DOUBLE tf FROM (SELECT doc_id, w, unnest(w) x FROM d) GROUP BY ALL),
i AS (SELECT x, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM t, n GROUP BY x),
s AS (SELECT q.doc_id query_id, t.doc_id, round(sum(q.tf * idf * t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.size / average))), 6) score FROM t q JOIN i USING (x) JOIN t USING (x), n WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') body FROM pages),
h AS (SELECT page_id, strlen(body) payload_bytes, sha1(body) hex, max(page_id) OVER (PARTITION BY body) head FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> head THEN head END refers_to
FROM h
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) x FROM documents),
c AS (SELECT doc_id, c * 1000 base, substr(x, c * 2000 + 1, 2198) piece FROM (SELECT doc_id, x, unnest(range(strlen(x) // 2000 + 1)) c FROM d)),
s AS (SELECT doc_id, base + i p, md5_number(substr(piece, 2 * i + 1, 200)) h FROM (SELECT doc_id, base, piece, unnest(range(least(1000, strlen(piece) // 2 - 99))) i FROM c)),
f AS (SELECT h, min({'d': doc_id, 'p': p}) first FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) gap FROM s JOIN f USING (h) WHERE {'d': doc_id, 'p': p} <> first),
i AS (SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) run FROM r),
u AS (SELECT doc_id, run, min(p) a, max(p) + 100 z FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) before FROM u),
g AS (SELECT doc_id, count(*) n_spans, sum(z - a) n_removed, max(z) tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, strlen(x) // 2 n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * tail + 1), x))) kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

NEARDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END)) sh FROM d),
m AS (SELECT sh, min(doc_id) node, len(sh) n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT node, n, unnest(sh) x FROM m),
c AS (SELECT a.node a, b.node b, a.n x, b.n y, count(*) shared FROM t a JOIN t b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (x + y - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a node, a seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
o AS (SELECT node, min(seen) component FROM r GROUP BY 1)
SELECT s.doc_id, len(s.sh)::BIGINT n_shingles, coalesce(component, m.node, s.doc_id) component_id, s.doc_id = coalesce(component, m.node, s.doc_id) kept
FROM s LEFT JOIN m ON m.sh = s.sh LEFT JOIN o ON o.node = m.node
"""

DECONTAM = f"""
WITH d AS (SELECT doc_id, {_ALNUM} w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') item_id, {_ALNUM} w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') s FROM (SELECT item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) k FROM b WHERE len(w) > 0)),
q AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM d, (SELECT DISTINCT n FROM v))),
f AS (SELECT doc_id, k, n, item_id FROM q JOIN v USING (s, n)),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) p FROM f) GROUP BY 1),
i AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express, on tables whose ids are unique."""
    return {"op2_search": SEARCH, "op4_warc": WARC, "op5_substrings": SUBSTRINGS, "op7_neardup": NEARDUP, "op9_decontam": DECONTAM}
