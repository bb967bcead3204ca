"""SQL that states the results of operators 2, 3, 9 and 11 to 13 over whole tables."""

OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS b, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS fault FROM q
"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and floored means, one after the other; all numbers are whole and below 2**53."""

    def assign(k: int) -> str:
        near = "list_dot_product(c.x, c.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(v.x, v.x)"
        return f"a{k} AS MATERIALIZED (SELECT vec_id, p, m.e AS e, m.d AS d FROM (SELECT v.vec_id, v.p, min({{'d': {near}, 'e': c.e}}) AS m FROM part v JOIN c{k} c ON v.p = c.p GROUP BY v.vec_id, v.p))"

    ctes = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM k, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, x FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for k in range(rounds):
        ctes += [
            assign(k),
            f"s{k} AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k} JOIN part USING (vec_id, p), range(1, len(x) + 1) r(i) GROUP BY p, e, i)",
            f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM s{k} GROUP BY p, e) u ON u.p = c.p AND u.e = c.e)",
        ]
    ctes += [
        assign(rounds),
        "f AS (SELECT vec_id, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a%d GROUP BY vec_id)" % rounds,
        "h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, i, x[i] AS v FROM c%d, range(1, len(x) + 1) r(i)))" % rounds,
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h"


OP12_SQL = _codes()

_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_STEP = "CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
_CRC = f"""xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda s, b: list_reduce([xor(s, b)] || [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, z: {_STEP})))"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS bent FROM documents),
g AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
a AS (SELECT t, 0 AS level, i, n, leaf AS h FROM g
  UNION ALL SELECT t, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY t, level, i // 8, n),
lo AS MATERIALIZED (SELECT * FROM a), sr AS MATERIALIZED (SELECT t, level AS top, h FROM lo WHERE n = 1),
b AS (SELECT 0 AS level, t AS i, (SELECT count(*) FROM sr) AS n, h FROM sr
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 8, n),
up AS MATERIALIZED (SELECT * FROM b), root AS (SELECT h AS root FROM up WHERE n = 1),
s AS MATERIALIZED (
  SELECT t, level, i, coalesce((SELECT string_agg(y.h, '' ORDER BY y.i) FROM lo y WHERE y.t = x.t AND y.level = x.level AND y.i // 8 = x.i // 8 AND y.i < x.i), '') AS l,
    coalesce((SELECT string_agg(y.h, '' ORDER BY y.i) FROM lo y WHERE y.t = x.t AND y.level = x.level AND y.i // 8 = x.i // 8 AND y.i > x.i), '') AS r FROM lo x WHERE n > 1),
u AS MATERIALIZED (
  SELECT level, i, coalesce((SELECT string_agg(y.h, '' ORDER BY y.i) FROM up y WHERE y.level = x.level AND y.i // 8 = x.i // 8 AND y.i < x.i), '') AS l,
    coalesce((SELECT string_agg(y.h, '' ORDER BY y.i) FROM up y WHERE y.level = x.level AND y.i // 8 = x.i // 8 AND y.i > x.i), '') AS r FROM up x WHERE n > 1),
path AS MATERIALIZED (
  SELECT g.t, g.i, s.level AS k, s.l, s.r FROM g JOIN s ON s.t = g.t AND s.i = g.i // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL SELECT g.t, g.i, sr.top + u.level, u.l, u.r FROM g JOIN sr USING (t) JOIN u ON u.i = g.t // CAST(pow(8, u.level) AS BIGINT)),
f AS (SELECT t, i, 0 AS k, coalesce(bent, leaf) AS h FROM g UNION ALL SELECT f.t, f.i, f.k + 1, sha256(p.l || f.h || p.r) FROM f JOIN path p ON p.t = f.t AND p.i = f.i AND p.k = f.k),
z AS (SELECT t, i, arg_max(h, k) AS folded_root FROM f GROUP BY t, i), pr AS (SELECT t, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM path GROUP BY t, i)
SELECT doc_id, leaf, sr.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g JOIN sr USING (t) JOIN z USING (t, i) LEFT JOIN pr USING (t, i), root
"""

# Words are those of the operator: separated by space and the five control characters that are white space.
OP2_SQL = """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS k FROM w, range(1, len(ws) - 33) r(i)),
h AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(k)) AS n FROM p) WHERE n > 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM h, range(0, 35) r(j)),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT w.doc_id, string_agg(ws[i], ' ' ORDER BY i) AS kept FROM w JOIN n USING (doc_id), range(1, len(ws) + 1) r(i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.i = r.i) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP3_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(b[i : i + 199]) AS k FROM d, range(1, CAST(n AS BIGINT) - 198) r(i)),
h AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM p) WHERE c > 1),
s AS (SELECT doc_id, i, i - lag(i) OVER w AS gap FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
cut AS MATERIALIZED (SELECT doc_id, run, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS spans, sum(hi - lo + 1) AS removed, max(hi) AS last FROM cut GROUP BY 1),
between_cuts AS (SELECT doc_id, run, hex(b[coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) + 1 : lo - 1]) AS x FROM cut JOIN d USING (doc_id)),
k AS (SELECT doc_id, string_agg(x, '' ORDER BY run) AS x FROM between_cuts GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN b ELSE unhex(x || hex(b[last + 1 : n])) END) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [hash(ws)] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i : i + 2]))) END AS t FROM w),
o AS MATERIALIZED (SELECT doc_id, list_sort(t) AS t FROM s),
c AS MATERIALIZED (SELECT min(doc_id) AS node, t, len(t) AS m FROM o WHERE len(t) > 0 GROUP BY t),
e AS MATERIALIZED (SELECT node, m, unnest(t) AS x FROM c),
l AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * b.m >= 90 * a.m AND 100 * a.m >= 90 * b.m
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 90 * (any_value(a.m) + any_value(b.m) - count(*))),
j AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, j.b FROM r JOIN j ON j.a = r.b),
m AS (SELECT a AS node, min(b) AS root FROM r GROUP BY 1)
SELECT o.doc_id, CAST(len(o.t) AS BIGINT) AS n_shingles, coalesce(m.root, o.doc_id) AS component_id FROM o LEFT JOIN c ON c.t = o.t LEFT JOIN m ON m.node = c.node
"""
