"""DuckDB SQL of the operators whose results SQL can state over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# base32 of a SHA-1: five hexadecimal digits are four characters
_BASE32 = ("array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST("
           "((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 "
           "AS BIGINT), 1)), '')")

OP4 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM f
"""

OP5 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT doc_id, p, word, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS n FROM t
      WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT *, n = 35 AND count(*) FILTER (WHERE n = 35) OVER (PARTITION BY k) > 1 AS twice FROM k),
g AS (SELECT doc_id, p, word, max(CAST(twice AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id) x
ON x.doc_id = d.doc_id
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bt AS (SELECT item, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, least(len(ws), 10) AS n, len(ws) AS all_n FROM b),
bw AS (SELECT DISTINCT item, n, k FROM (SELECT item, n, all_n, p, string_agg(word, ' ') OVER (PARTITION BY item ORDER BY p
        ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS k FROM bt) WHERE p <= all_n - n + 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS all_n FROM d),
tw AS (SELECT doc_id, n, p, k FROM (SELECT doc_id, l.n, p, all_n, string_agg(word, ' ') OVER (PARTITION BY doc_id, l.n ORDER BY p
        ROWS BETWEEN CURRENT ROW AND l.n - 1 FOLLOWING) AS k FROM t CROSS JOIN (SELECT DISTINCT n FROM bw) l) WHERE p <= all_n - n + 1),
h AS (SELECT tw.doc_id, tw.p, tw.n, bw.item FROM tw JOIN bw ON bw.n = tw.n AND bw.k = tw.k),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
  sha256(coalesce(hi.items, '')) AS items_sha256, hw.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""

# The quotients are dealt one block at a time here; targets stop at their ceilings round by round.
OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS o FROM d GROUP BY source),
w AS (SELECT *, o % 3 + 1 AS w FROM s),
rounds AS (
  SELECT 0 AS r, source, o, n, w, false AS full_, (SELECT sum(n) FROM w) AS rest, (SELECT sum(w) FROM w) AS ws FROM w
  UNION ALL
  SELECT r + 1, source, o, n, w, f, (sum(n) OVER ()) - coalesce(sum(3 * n) FILTER (WHERE f) OVER (), 0), coalesce(sum(w) FILTER (WHERE NOT f) OVER (), 1)
  FROM (SELECT *, full_ OR rest * w > 3 * n * ws AS f FROM rounds) WHERE r < (SELECT count(*) FROM w)),
t AS (SELECT source, o, CAST(n AS BIGINT) AS n, CASE WHEN full_ THEN CAST(3 * n AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(ws AS DOUBLE) END AS target
      FROM rounds WHERE r = (SELECT max(r) FROM rounds)),
b AS (SELECT greatest(1, least(1024, floor(min(target) FILTER (WHERE target > 0) / 128))) AS block, sum(target) AS total FROM t),
q AS (SELECT o, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, o, k) AS place
      FROM (SELECT o, target, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 3)) AS k FROM t, b WHERE target > 0)),
g AS (SELECT o, count(*) AS blocks FROM q WHERE place <= (SELECT floor(total / block + 0.5) FROM b) GROUP BY o),
l AS (SELECT doc_id, d.size, t.n, t.target, coalesce(g.blocks, 0) AS blocks, CAST(least(coalesce(g.blocks, 0) * b.block, 3 * t.n) AS BIGINT) AS upto,
        CAST(sum(d.size) OVER (PARTITION BY t.o ORDER BY k, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS till
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN g ON g.o = t.o CROSS JOIN b)
SELECT doc_id, size, n AS source_size, target, CAST(list_sum(list_transform(range(0, 3), lambda lap:
    greatest(0, least(till + lap * n, upto) - (till - size + lap * n)))) AS BIGINT) AS taken, blocks AS source_blocks
FROM l
"""

# All distances of all vectors to all centroids, round by round.
_NEAREST = """SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': k.c}}) AS best
  FROM v CROSS JOIN c{0} k GROUP BY v.r"""
_ROUND = """a{0} AS MATERIALIZED (""" + _NEAREST + """),
m{0} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x FROM (
  SELECT a.best.c AS c, p, sum(e) AS s, count(*) AS n FROM (SELECT r, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM v) JOIN a{0} a USING (r)
  GROUP BY a.best.c, p) GROUP BY c),
c{1} AS MATERIALIZED (SELECT k.c, CAST(coalesce(m.x, k.x) AS BIGINT[]) AS x FROM c{0} k LEFT JOIN m{0} m ON m.c = k.c),
"""

OP13 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
  SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8)),
""" + "".join(_ROUND.format(i, i + 1) for i in range(10)) + "a10 AS MATERIALIZED (" + _NEAREST.format(10) + """),
o AS (SELECT vec_id, best.c AS c, CAST(best.d AS BIGINT) AS d FROM a10 JOIN v USING (r))
SELECT vec_id, CAST(o.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM o JOIN c10 k ON k.c = o.c
"""

ORACLES = {"op4_capture_index": OP4, "op5_super_kmers": OP5, "op6_decontamination": OP6, "op11_sainte_lague": OP11, "op13_rotated_filter": OP13}
