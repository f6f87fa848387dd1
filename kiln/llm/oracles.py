"""DuckDB SQL for the queries that SQL can express. It compares everything with everything that
shares a shingle or a rule, which is right and affordable on the small tables it is meant for."""

from __future__ import annotations

from kiln.llm.url_rules import HOST_RULES, PATTERNS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(column: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), "
            r"'[\x20\x09-\x0D]+'), lambda x: x <> '')")


_GRAMS = ("CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) "
          "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END")

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT doc_id, list_distinct({_GRAMS}) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c USING (doc_id)"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS n, unnest({_GRAMS}) AS h FROM b),
ic AS (SELECT item_id, n, h, count(*) AS c FROM ig GROUP BY ALL),
dg AS (SELECT doc_id, len(w) AS m, unnest({_GRAMS}) AS h, generate_subscripts({_GRAMS}, 1) - 1 AS pos FROM d WHERE len(w) > 0),
hit AS (SELECT DISTINCT doc_id, item_id, n, m,
               unnest(range(greatest(0, least(pos + 5 - n, m - n)), greatest(0, least(pos, m - n)) + 1)) AS start FROM dg JOIN ic USING (h)),
win AS (SELECT doc_id, item_id, n, start, least(n, m) AS len FROM hit),
own AS (SELECT win.doc_id, item_id, start, len, dg.h, count(*) AS k FROM win JOIN dg ON dg.doc_id = win.doc_id
        AND dg.pos >= start AND dg.pos <= start + greatest(len - 5, 0) GROUP BY ALL),
fit AS (SELECT own.doc_id, own.item_id, start, len, sum(least(k, coalesce(c, 0))) AS shared, sum(k) AS mine FROM own
        LEFT JOIN ic ON ic.item_id = own.item_id AND ic.h = own.h GROUP BY ALL),
tot AS (SELECT item_id, sum(c) AS total FROM ic GROUP BY item_id),
ok AS (SELECT doc_id, item_id, start, len, shared, mine + tot.total - shared AS total FROM fit JOIN tot USING (item_id)
       WHERE 100 * shared >= 80 * (mine + tot.total - shared))
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(len AS INT) AS n_words, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total
FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, start) = 1"""

_RULES = ", ".join(f"({_text(h)}, {_text(p)}, {_text(a)})" for a, h, p in HOST_RULES)
_BAD = ", ".join(f"CASE WHEN regexp_matches(lower(host || path), {_text(p)}) THEN {_text(p)} END" for p, _ in PATTERNS)

URLS = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS i,
             translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rh, rp, action) AS (VALUES {_RULES}),
f AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i),
g AS (SELECT *, list_max([{_BAD}]) AS pattern FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM g LEFT JOIN f USING (i)"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
      WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_FEATURES = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLING = f"""
WITH t AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(b))),
d AS (SELECT doc_id, {_FEATURES} AS w FROM documents),
b AS (SELECT {_FEATURES} AS w FROM benchmark),
v AS (SELECT DISTINCT unnest(w) AS f FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex(f)) // 2), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))),
             lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, t),
ds AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS f FROM d) JOIN c USING (f) GROUP BY bucket),
bs AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS f FROM b) JOIN c USING (f) GROUP BY bucket),
g AS (SELECT c.f, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM ds) + 10000) AS DOUBLE)
             / CAST((s + 1) * ((SELECT coalesce(sum(t), 0) FROM bs) + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM c JOIN ds USING (bucket) LEFT JOIN bs USING (bucket)),
o AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS f FROM d) JOIN g USING (f) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN o USING (doc_id)),
k AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place FROM s)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM s WHERE n_features >= 20) THEN place END AS rank FROM k"""

REVISITS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS kept FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p JOIN f USING (html)"""

ORACLE = {"op11_hard_negatives": HARD_NEGATIVES, "op12_importance_resampling": RESAMPLING, "op13_warc_revisits": REVISITS,
          "op1_minhash_dedup": NEAR_DUPLICATES, "op7_decontaminate": LEAKS, "op8_url_rules": URLS}
