"""DuckDB SQL for the corpus queries that SQL can express.

The others are held against brute force in tests: EM (op5), signatures and classes (op1), host ranks (op2), classifiers
(op4), Markov models (op7), random draws (op8) and tokenizers (op10) are beyond it."""

_WORDS = r"CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END"
_FOLDED = r"CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END"

SQL: dict[str, str] = {
    "op3_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, source IS NULL AS absent, coalesce(source, '') AS name FROM documents),
s AS (SELECT absent, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY absent, name) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, absent, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT absent, name, source_size, least(2.0::DOUBLE * source_size, greatest((SELECT max(level) FROM l), 0) * weight) AS target,
  CAST(CAST('0x' || substr(md5('mix|' || (CASE WHEN absent THEN '1' ELSE '0' END) || '|' || name), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS o FROM l),
n AS (SELECT d.*, source_size, target, o, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.absent, d.name ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS k FROM d JOIN t USING (absent, name)),
c AS (SELECT *, CAST(floor(o + k * rate) - floor(o + (k - 1) * rate) AS BIGINT) AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c""",
    "op6_substrings": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
win AS (SELECT r, i, sha256(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(35)) AS j FROM win JOIN rep USING (h))),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words LEFT JOIN (SELECT r, p, 1 AS gone FROM hit) x USING (r, p) WHERE gone IS NULL GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)""",
    "op9_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, i, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT r, i, dw.k AS k, item FROM dw JOIN iw USING (k, s)),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(k)) AS j FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op11_phrases"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i+m-1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.phrase = array_to_string(k.ws[k.k+1:], ' ')),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL),
r AS (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, o.a DESC, o.phrase) AS rank, o.phrase, o.a, l, r, n, score FROM o JOIN t ON t.lang = o.lang LEFT JOIN i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * o.a)
SELECT * FROM r WHERE rank <= 2000"""


def _lloyd(rounds: int) -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8))",
    ]
    near = "SELECT vec_id, v.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{k} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c.c) = 1"
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        parts.append(f"m{k} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.x, o.x) AS x FROM c{k} o LEFT JOIN (SELECT c, list(CAST({floor} AS BIGINT) ORDER BY i) AS x FROM m{k} GROUP BY c) f USING (c))")
    parts.append(f"z AS ({near.format(k=rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, z.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON c{rounds}.c = z.c"""


SQL["op12_centroids"] = _lloyd(10)

SQL["op13_near_vectors"] = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS MATERIALIZED (SELECT i, vec_id, label, x, sqrt(list_dot_product(x, x)) AS len FROM e
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = len(x) AND len(list_filter(x, lambda v: v <> 0)) > 0),
l AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.label = b.label AND a.i <> b.i AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.len * b.len) >= 0.98),
r(a, b) AS (SELECT i, i FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a, min(e.vec_id) AS component_id FROM r JOIN e ON e.i = r.b GROUP BY r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(e.vec_id = component_id, component_id IS NULL) AS kept FROM e JOIN c ON c.a = e.i LEFT JOIN n ON n.a = e.i"""
