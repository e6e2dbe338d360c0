"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from tidemark.llm import decontaminate, filters, imatch, packing, pii, prefixes, quality, secrets, simhash, suffixes, superkmers, vectors, warc
from tidemark.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def op2_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_imatch(spark, sf_dir):
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_suffixes(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op10_superkmers(spark, sf_dir):
    return superkmers.remove_repeats(table(spark, sf_dir, "documents"))


def op11_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op12_filters(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefixes(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_warc": op3_warc, "op4_imatch": op4_imatch, "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_decontaminate": op7_decontaminate, "op8_secrets": op8_secrets, "op9_suffixes": op9_suffixes, "op10_superkmers": op10_superkmers, "op11_vectors": op11_vectors, "op12_filters": op12_filters, "op13_prefixes": op13_prefixes}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op11_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

ORACLE_SQL["op12_filters"] = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
ids AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
failed AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, least IS NOT NULL)} AS f FROM words JOIN ids USING (text)),
masks AS (
  SELECT doc_id, part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS m FROM failed),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id),
counts AS (SELECT part, m, count(*) AS c, sum(coalesce(g, 0)) AS g, sum(coalesce(t, 0)) AS t FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, m),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k, o[:k - 1] AS before, o[k] AS own FROM orders, range(1, 6) r(k)),
rows AS (
  SELECT part, o, k, own, before, m, c, g, t, contains(m, own) AS hit, len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(m, x))) > 0 AS gone FROM counts, steps),
totals AS (
  SELECT part, o AS filter_order, k::INT AS step, own, sum(CASE WHEN NOT gone AND NOT hit THEN c ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND hit THEN c ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND hit THEN c ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = own THEN c ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND hit THEN t ELSE 0 END)::BIGINT AS toxic_lost
  FROM rows GROUP BY part, o, k, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM totals
"""

ORACLE_SQL["op13_prefixes"] = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM turns),
rebuilt AS (
  SELECT c.conv_id, t.pos AS k, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos + 1000000 AS k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS path, length(text) AS tokens FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
  UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(tokens) AS tokens FROM paths GROUP BY path, depth),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((d.n - 1) * d.tokens) AS saved
  FROM nodes d CROSS JOIN LATERAL (SELECT d.path[:i] AS path FROM range(0, d.depth + 1) r(i)) a LEFT JOIN kids k ON k.path = d.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""
