"""DuckDB SQL for the queries that SQL can express on whole tables."""

from . import mixing, quality


_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits
  FROM pages),
d AS (
  SELECT *, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
           + 16 * (substr(bits, 5 * i::INT + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i::INT + 2, 1) = '1')::INT
           + 4 * (substr(bits, 5 * i::INT + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * i::INT + 4, 1) = '1')::INT
           + (substr(bits, 5 * i::INT + 5, 1) = '1')::INT, 1)), lambda a, b: a || b) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_LISTS = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in {**quality.COMMON_WORDS, "other": quality.COMMON_WORDS_OTHER}.items()) + "}"

_FIXED = ", ".join(
    f"('{lang}', '{kind}', {i}, {m}::DOUBLE)"
    for lang, parts in quality.FIXED_REFERENCES.items()
    for kind, part in zip("cw", parts, strict=True)
    for i, m in enumerate(part, 1)
)

_QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS q
  FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM d),
win AS (SELECT r, list_transform(range(len(ws) - 7), lambda i: array_to_string(ws[i + 1 : i + 8], ' ')) AS wi FROM w WHERE len(ws) >= 8),
x AS (SELECT r, unnest(wi) AS s, generate_subscripts(wi, 1) AS i FROM win),
y AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM x) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(later - i, 8)))::BIGINT AS n FROM y GROUP BY r),
counts AS (
  SELECT r, q, length(t) AS chars, len(ws) AS words,
    [length(regexp_replace(t, '\\P{{Ll}}', '', 'g')), length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')),
     length(regexp_replace(t, '\\P{{Lu}}', '', 'g')), symbols,
     length(regexp_replace(regexp_replace(t, '[#*$%&|<>]', '', 'g'), '\\P{{P}}', '', 'g')), length(regexp_replace(t, '\\P{{Nd}}', '', 'g'))] AS c,
    list_transform({_LISTS}[q], lambda k: len(list_filter(ws, lambda v: v = k))) AS k
  FROM w),
hist AS (
  SELECT r, q, 'c' AS kind, chars AS n, chars >= {quality.MIN_CHARS} AS judged, list_append(c, chars - list_sum(c)) AS h FROM counts
  UNION ALL
  SELECT r, q, 'w', words, words >= {quality.MIN_WORDS}, list_append(k, words - list_sum(k)) FROM counts),
share AS (SELECT r, q, kind, judged, unnest(h) / n AS p, generate_subscripts(h, 1) AS i FROM hist WHERE n > 0),
sound AS (
  SELECT min(r) AS r FROM w JOIN counts USING (r, q) LEFT JOIN rep USING (r)
  WHERE chars >= {quality.MIN_CHARS} AND words >= 20 AND 100 * coalesce(rep.n, 0) <= 30 * words GROUP BY q, t),
mid AS (SELECT q, kind, i, median(round(p * {quality.STEPS})) AS m, count(*) AS texts FROM share JOIN sound USING (r) GROUP BY ALL),
ref AS (
  SELECT q, kind, i, m / sum(m) OVER (PARTITION BY q, kind) AS m FROM mid WHERE texts >= {quality.MIN_REFERENCE} OR q = 'other'
  UNION ALL
  SELECT * FROM (VALUES {_FIXED}) AS f (q, kind, i, m) WHERE q NOT IN (SELECT q FROM mid WHERE texts >= {quality.MIN_REFERENCE})),
dist AS (
  SELECT r, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + m)) ELSE 0 END + CASE WHEN m > 0 THEN m * ln(2 * m / (p + m)) ELSE 0 END), 0) / (2 * ln(2))) AS j
  FROM share JOIN ref USING (q, kind, i) WHERE judged GROUP BY r, kind),
pair AS (SELECT r, coalesce(max(j) FILTER (kind = 'c'), 0) AS c, coalesce(max(j) FILTER (kind = 'w'), 0) AS w FROM dist GROUP BY r),
base AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, symbols::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (coalesce(c, 0) > {quality.MAX_CLASS_DISTANCE} OR coalesce(w, 0) > {quality.MAX_WORD_DISTANCE} OR coalesce(c, 0) + coalesce(w, 0) > {quality.MAX_SUM}) AS kept
FROM base LEFT JOIN pair USING (r)
"""

_MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS dice
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS rate
  FROM w WINDOW earlier AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT rate FROM f WHERE rate * weight <= cap ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, k, source_size, coalesce(least(cap, (SELECT rate FROM r) * weight), cap) AS target FROM f),
b AS (SELECT sum(target) AS words, greatest(1, least({mixing.BLOCK_WORDS}, floor(sum(target) / {mixing.SLOTS})))::BIGINT AS block FROM t),
g AS (
  SELECT t.*, (sum(target) OVER (ORDER BY k) - target) / (SELECT words FROM b) AS lo, sum(target) OVER (ORDER BY k) / (SELECT words FROM b) AS hi
  FROM t),
p AS (
  SELECT i AS slot, reverse(lpad(bin(i), {mixing.BITS}, '0'))::BIT::BIGINT / pow(2, {mixing.BITS}) AS x
  FROM (SELECT unnest(range((SELECT ceil(words / block)::BIGINT FROM b))) AS i)),
h AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS turn FROM p JOIN g ON x >= lo AND x < hi),
n AS (SELECT k, least(count(*) * any_value(block), 2 * any_value(source_size))::BIGINT AS given FROM h JOIN t USING (k), b GROUP BY k),
e AS (
  SELECT doc_id, size, source_size, target, t.k, coalesce(given, 0) AS given,
         coalesce(sum(size) OVER (PARTITION BY t.k ORDER BY dice, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n USING (k)),
m AS (SELECT *, greatest(0, least(size, given - start)) + greatest(0, least(size, given - source_size - start)) AS taken FROM e)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, slot AS first_slot
FROM m CROSS JOIN b LEFT JOIN h ON taken > 0 AND h.k = m.k AND h.turn = m.start // block
"""

ORACLES: dict[str, str] = {"op4_low_discrepancy_mixing": _MIX, "op1_quality_divergence": _QUALITY, "op7_warc_round_trip": _WARC, "op8_threshold_top_k": _TOP_K}
