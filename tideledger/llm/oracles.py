"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from . import best_position, licenses, mixing, spherical_caps

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS x(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT k, w, n FROM d CROSS JOIN ns WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) AS x(i)),
hit AS (SELECT k, n, i, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, n, i FROM hit), unnest(range(i, i + n)) AS x(p) GROUP BY k),
its AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit WHERE item_id IS NOT NULL GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""

MIXTURE = f"""
WITH s AS (SELECT row_number() OVER () AS k, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s GROUP BY source),
t1 AS (SELECT *, 1 + number % 3 AS weight, {mixing.MAX_TIMES} * source_size AS cap FROM t0),
t2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM t1),
t3 AS (SELECT *, rest * weight >= cap * weights AS cut FROM t2),
op AS (SELECT rest AS o_rest, weights AS o_weights FROM t3 WHERE NOT cut ORDER BY cap / weight, number LIMIT 1),
t4 AS (SELECT t3.*, CASE WHEN cut THEN CAST(cap AS DOUBLE) ELSE CAST(weight * o_rest AS DOUBLE) / CAST(o_weights AS DOUBLE) END AS target FROM t3 LEFT JOIN op ON true),
t5 AS (SELECT *, CAST(greatest(1, least({mixing.BLOCK}, floor(least(CAST(source_size AS DOUBLE), target) / {mixing.PARTS}))) AS BIGINT) AS block FROM t4),
t6 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, CAST(round(target / block) AS BIGINT) AS slots FROM t5),
t AS (SELECT *, sum(slots) OVER (ORDER BY number) - slots AS lo, sum(slots) OVER (ORDER BY number) AS hi FROM t6),
n AS (SELECT CAST(max(hi) AS BIGINT) AS total FROM t),
p0 AS (SELECT i, total, (i // 1048576) * {mixing.PHI_20!r}::DOUBLE AS turn, (i % 1048576) * {mixing.PHI!r}::DOUBLE AS small FROM n, unnest(range(total)) AS x(i)),
p AS (SELECT i, (turn - floor(turn) + small - floor(turn - floor(turn) + small)) * CAST(total AS DOUBLE) AS place FROM p0),
r AS (SELECT number, n_blocks, row_number() OVER (PARTITION BY number ORDER BY i) - 1 AS rank FROM p JOIN t ON place >= lo AND place < hi),
takes AS (SELECT number, rank % n_blocks AS piece, count(*) AS times FROM r WHERE rank < {mixing.MAX_TIMES} * n_blocks GROUP BY 1, 2),
laid AS (SELECT s.k, doc_id, size, source_size, target, number, block, sum(size) OVER (PARTITION BY number ORDER BY sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), size, s.k) AS upto FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, upto - size AS since FROM laid WHERE size > 0),
pc AS (SELECT cut.*, piece FROM cut, unnest(range(CAST(since // block AS BIGINT), CAST((upto - 1) // block AS BIGINT) + 1)) AS x(piece)),
got AS (SELECT k, sum((least(upto, (pc.piece + 1) * block) - greatest(since, pc.piece * block)) * times) AS taken FROM pc JOIN takes USING (number, piece) GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN got USING (k)
"""


def _license_sql() -> str:
    values = ", ".join(f"({n}, {p}, '{k}', '{r}', '{label}', {s}::DOUBLE)" for n, p, k, _, r, label, s, _ in licenses.rules())
    bases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE_PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT *, CASE WHEN len(w) = 0 THEN ' ' ELSE ' ' || array_to_string(w, ' ') || ' ' END AS flat FROM d),
bp(phrase, label) AS (VALUES {bases}),
ba AS (SELECT k, i - 1 AS pos, label FROM f, bp, unnest(range(1, len(w) + 1)) AS x(i) WHERE contains(flat, ' ' || phrase || ' ') AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
bs AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS base_list FROM ba GROUP BY k),
ru(rule, priority, keyword, pattern, label, points) AS (VALUES {values}),
tr AS (SELECT k, ru.*, regexp_extract_all(flat, pattern) AS hits, regexp_split_to_array(flat, pattern) AS parts FROM f JOIN ru ON contains(flat, ' ' || keyword)),
mt AS (SELECT k, rule, priority, label, points, list_sum([len(p) FOR p IN parts[1:j]]) + coalesce(list_sum([len(h) FOR h IN hits[1 : j - 1]]), 0) AS a, list_sum([len(p) FOR p IN parts[1:j]]) + list_sum([len(h) FOR h IN hits[1:j]]) AS z FROM tr, unnest(range(1, len(hits) + 1)) AS x(j)),
st AS (SELECT * FROM mt m WHERE NOT EXISTS (SELECT 1 FROM mt o WHERE o.k = m.k AND o.priority >= m.priority AND o.z >= m.z AND (o.a < m.a OR o.a = m.a AND (o.z > m.z OR o.z = m.z AND (o.priority > m.priority OR o.priority = m.priority AND o.rule < m.rule))))),
ow AS (SELECT k, list(DISTINCT label) AS own, max(points) AS points FROM st GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base_list, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(base_list, [])))), ','), '') AS labels, greatest(coalesce(points, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM f LEFT JOIN bs USING (k) LEFT JOIN ow USING (k)
"""


SPHERICAL_CAPS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
p AS (SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_cosine_similarity(a.e, b.e) >= {spherical_caps.MIN_COSINE}),
r(k, s) AS (SELECT k, k FROM v UNION SELECT p.b, r.s FROM r JOIN p ON p.a = r.k)
SELECT v.vec_id, CAST((SELECT count(*) FROM p WHERE p.a = v.k) AS BIGINT) AS n_links, min(o.vec_id) AS component_id, coalesce(v.vec_id = min(o.vec_id), false) AS kept
FROM v JOIN r ON r.k = v.k JOIN v AS o ON o.k = r.s GROUP BY v.k, v.vec_id
"""

BEST_POSITION = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_WORDS}) AS w FROM benchmark),
n AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
f AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, n GROUP BY term, docs),
m AS (SELECT k, doc_id, 10 + (90 * len(w)::BIGINT * docs) // words AS m FROM d, n WHERE len(w) > 0),
s AS (SELECT q, item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM (SELECT q, item_id, unnest(w) AS term FROM b) JOIN t USING (term) JOIN f USING (term) JOIN m USING (k) GROUP BY q, item_id, k, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= {best_position.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op3_source_mix": MIXTURE, "op6_license_scan": _license_sql(), "op11_spherical_caps": SPHERICAL_CAPS, "op13_best_position": BEST_POSITION}
