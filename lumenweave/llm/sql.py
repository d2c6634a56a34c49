"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, lang, text,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
w AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    words, row_number() OVER () AS rid
  FROM c),
g AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS p, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS t
  FROM w WHERE len(words) >= 3),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY rid),
f AS (
  SELECT w.doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    {'symbols': coalesce(n_symbols / nullif(n_words, 0), 0), 'capitals': coalesce(n_upper / nullif(word_chars, 0), 0),
     'repeats': coalesce(coalesce(n_repeat_words, 0) / nullif(n_words, 0), 0), 'dup_lines': coalesce(n_dup_lines / nullif(n_lines, 0), 0)} AS m
  FROM w LEFT JOIN rw USING (rid)),
l AS (
  SELECT lang, unnest(['symbols', 'capitals', 'repeats', 'dup_lines']) AS rule, unnest([m.symbols, m.capitals, m.repeats, m.dup_lines]) AS v
  FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
s AS (SELECT count(DISTINCT coalesce(lang, chr(1))) AS strata FROM l),
k AS (
  SELECT lang, rule, g, (20 - g) / 20.0::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (v >= (20 - g) / 20.0::DOUBLE) AS k
  FROM l, range(0, 20) AS t(g) GROUP BY lang, rule, g),
b AS (
  SELECT k.*, k < n * 0.005 AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::DOUBLE) + (n - i) * ln(0.995::DOUBLE)))
    FROM (SELECT unnest(range(0, k.k + 1)) AS i)) <= 0.05 / (strata * 4) AS ok
  FROM k, s),
z AS (
  SELECT lang, min(cutoff) FILTER (good AND rule = 'symbols') AS symbols, min(cutoff) FILTER (good AND rule = 'capitals') AS capitals,
    min(cutoff) FILTER (good AND rule = 'repeats') AS repeats, min(cutoff) FILTER (good AND rule = 'dup_lines') AS dup_lines
  FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY g) AS good FROM b) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(m.symbols >= z.symbols, false) AND NOT coalesce(m.capitals >= z.capitals, false)
    AND NOT coalesce(m.repeats >= z.repeats, false) AND NOT coalesce(m.dup_lines >= z.dup_lines, false) AS kept
FROM f LEFT JOIN z ON f.lang IS NOT DISTINCT FROM z.lang
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM d GROUP BY source),
r AS (
  SELECT *, [5.0, 2.0, 1.0][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, ratio) FROM v WHERE level <= ratio) * weight) AS target FROM v),
q AS (
  SELECT doc_id, d.source, size, key, source_size, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    row_number() OVER () AS rid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, coalesce((epoch * source_size + cum)::DOUBLE / target, 0) AS finish FROM q, (SELECT unnest([0, 1]) AS epoch)),
o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, epoch, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  sum(CASE WHEN total <= 1.5 * (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM o GROUP BY rid, doc_id
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest
  FROM (SELECT DISTINCT h FROM p)),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN b USING (h) JOIN m USING (h)
"""

OP11 = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM b WHERE len(w) > 0),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dw AS (
  SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS pos, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
h AS (SELECT DISTINCT rid, m, pos, win FROM dw SEMI JOIN bw USING (m, win)),
n AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + m)) AS p FROM h) GROUP BY rid),
i AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h JOIN bw USING (m, win) WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""

OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s ON p.place <= 5 AND p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT part, n, good, toxic, failed, filter_order, step, substr(filter_order, step, 1) AS letter,
    (SELECT min(instr(filter_order, y)) FROM (SELECT unnest(string_split(failed, '')) AS y) WHERE y <> '') AS gone
  FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(failed, letter) AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3, "op5_mixing_sources": OP5, "op10_warc": OP10, "op11_decontamination": OP11, "op12_hard_negatives": OP12, "op13_filter_audit": OP13}
