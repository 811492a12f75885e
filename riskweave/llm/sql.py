"""DuckDB SQL of the queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]+"

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     r AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN r.last IS NULL OR r.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r.last <> p.page_id THEN r.last END AS refers_to
FROM p LEFT JOIN r ON p.h = r.h
"""

OP10 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, list_inner_product(x, x) AS q FROM v
      WHERE len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = len(x) AND list_inner_product(x, x) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b
      WHERE a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / sqrt(a.q * b.q) >= 0.95),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings
      UNION SELECT e.b, r.seen FROM r JOIN e ON r.vec_id = e.a WHERE r.seen < e.b),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""

OP7 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, len(w) AS len, generate_subscripts(w, 1) AS i, unnest(w) AS b FROM d),
u AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY b) AS cb, count(*) OVER (PARTITION BY r, b) AS ob FROM p),
g AS (SELECT *, lag(b) OVER x AS a, lag(cb) OVER x AS ca, lag(ob) OVER x AS oa FROM u WINDOW x AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, count(*) OVER (PARTITION BY a, b) AS cab, count(*) OVER (PARTITION BY r, a, b) AS oab FROM g),
s AS (SELECT r, CASE WHEN a IS NOT NULL AND cab > oab THEN ln(cab - oab) - ln(ca - oa)
             ELSE CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(cb - ob, 1)) - ln(greatest(n - len, 1)) END AS x FROM k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, round(avg(s.x) * 1e6 - 0.3767) / 1e6 AS score
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id, d.w
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
u AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM x),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON r.doc_id = e.a WHERE r.seen < e.b),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP1 = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) * sqrt(sqrt(CAST(count(*) AS DOUBLE))) AS w
      FROM documents GROUP BY source),
q AS (SELECT source, n, greatest(1000, 2 * count(*) OVER ()) AS p,
        w / sum(w) OVER () * (greatest(1000, 2 * count(*) OVER ()) - count(*) OVER ()) AS q,
        count(*) OVER () AS m FROM s),
t AS (SELECT source, n, p, CAST(1 + floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, source NULLS FIRST)
        <= p - m - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share, CAST(ceil(n / 16.0) AS BIGINT) AS blocks,
        row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM q),
f AS (SELECT *, max(CAST(ceil(blocks / CAST(share AS DOUBLE)) AS BIGINT)) OVER () AS frames FROM t),
frame(slot, done, pick) AS (
    SELECT CAST(-1 AS BIGINT), (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM t), CAST(NULL AS BIGINT)
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda d, i: CASE WHEN i = w THEN d + 1 ELSE d END), w
    FROM (SELECT slot, done, list_sort(list_filter(list_transform(done, lambda d, i: CASE
              WHEN (d * k.p) // k.a[i] <= slot + 1 THEN struct_pack(due := ((d + 1) * k.p + k.a[i] - 1) // k.a[i], i := i) END),
              lambda c: c IS NOT NULL))[1].i AS w, k.p
          FROM frame, (SELECT max(p) AS p, list(share ORDER BY i) AS a FROM t) k) z WHERE slot + 1 < z.p),
k AS (SELECT pick AS i, list(slot ORDER BY slot) AS slots FROM frame WHERE pick IS NOT NULL GROUP BY pick),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS rank,
        row_number() OVER (PARTITION BY source, doc_id) - 1 AS copy FROM documents),
e AS (SELECT f.*, k.slots, max(((f.blocks - 1) // f.share) * f.p + k.slots[(f.blocks - 1) % f.share + 1]) OVER () AS final
      FROM f JOIN k ON k.i = f.i),
b AS (SELECT r.*, e.* EXCLUDE (source), unnest(range(r.rank // 16, e.frames * e.share, e.blocks)) AS kth
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, copy, kth // blocks AS epoch, (kth // share) * p + slots[kth % share + 1] AS slot,
       ((kth // share) * p + slots[kth % share + 1]) * 16 + rank % 16 AS position
FROM b WHERE (kth // share) * p + slots[kth % share + 1] <= final
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
              ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
"""

_DISTANCE = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"


def _op12(rounds: int) -> str:
    """Every round as plain full scans of the codebooks."""
    steps = ["""b0 AS MATERIALIZED (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry
        FROM p QUALIFY entry < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, min({{'d': {_DISTANCE}, 'e': b.entry}}) AS best
        FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, best.e AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}),
m{r} AS (SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS DOUBLE) AS v FROM s{r} GROUP BY part, entry, i),
n{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM m{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, k AS part, q[len(q) // 4 * k + 1:len(q) // 4 * (k + 1)] AS x FROM v, (SELECT unnest(range(4)) AS k)),
{(","+chr(10)).join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
k AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, k.h AS codebooks_sha256
FROM c JOIN v ON v.vec_id = c.vec_id, k
"""


OP12 = _op12(4)
