"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from marketloom.llm.url_filter import AMBIGUOUS, AMBIGUOUS_WEIGHT, HARMLESS, RULES, SOFT, SOFT_LIMIT, STRICT, TRACKING, UNSPACED

OP1 = """
WITH sized AS (
  SELECT doc_id, source, text, octet_length(encode(coalesce(text, '')))::BIGINT AS n,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (SELECT source, sum(n)::DOUBLE AS n, sqrt(sum(n)::DOUBLE) AS w FROM sized GROUP BY source),
rates AS (
  SELECT source, CASE WHEN n = 0 THEN 1.0 ELSE w * (SELECT sum(n) FROM sources) / ((SELECT sum(w) FROM sources) * n) END AS rate
  FROM sources),
terms AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM rates),
cdf AS (
  SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) ELSE (k = 0)::INT END)
         OVER (PARTITION BY source ORDER BY k) AS p
  FROM terms),
drawn AS (
  SELECT s.doc_id, s.source, s.text, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM s.source AND c.p <= s.u) AS n
  FROM sized s)
SELECT doc_id, source, copy_no::INT AS copy_no, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS mix_key, text
FROM (SELECT *, unnest(generate_series(1, n)) AS copy_no FROM drawn WHERE n > 0)
"""

OP4 = r"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

OP5 = """
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key,
         octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
groups AS (SELECT key, sum(size)::BIGINT AS size FROM sized GROUP BY key),
ranked AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS i FROM groups),
lead AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS key, (SELECT sum(size)::BIGINT FROM groups) AS rest, 24::BIGINT AS shards
  UNION ALL
  SELECT r.i, r.key, (l.rest - r.size)::BIGINT, l.shards - 1
  FROM lead l JOIN ranked r ON r.i = l.i + 1 WHERE l.shards > 1 AND r.size * l.shards >= l.rest),
state AS (SELECT count(*) - 1 AS n_alone, min(rest) AS rest, min(shards) AS shards FROM lead),
light AS (
  SELECT key, size, sum(size) OVER (ORDER BY key)::BIGINT AS upto, row_number() OVER (ORDER BY key) AS i
  FROM groups WHERE key NOT IN (SELECT key FROM lead WHERE key IS NOT NULL)),
line AS (SELECT list(upto ORDER BY i) AS sums, max(size) AS largest, max(upto) AS total FROM light),
search AS (
  SELECT greatest(largest, ((total + shards - 1) // shards)::BIGINT)::BIGINT AS low, total::BIGINT AS high FROM line, state
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT low, high, mid,
          list_reduce(list_prepend(0::BIGINT, list_transform(range(shards), lambda x: x::BIGINT)),
            lambda pos, x: coalesce(list_max(list_filter(sums, lambda y: y <= pos + mid)), 0)) >= total AS ok
        FROM (SELECT low, high, ((low + high) // 2)::BIGINT AS mid FROM search WHERE low < high), line, state)),
best AS (SELECT max(low) AS capacity FROM search WHERE low = high),
cuts AS (
  SELECT 0 AS n, 0::BIGINT AS pos
  UNION ALL
  SELECT n + 1, coalesce(list_max(list_filter(sums, lambda y: y <= pos + capacity)), 0)::BIGINT
  FROM cuts, line, best, state WHERE n < shards - 1 AND pos < total),
placed AS (
  SELECT key, (SELECT n_alone FROM state) + (SELECT count(*) FROM cuts WHERE n > 0 AND pos <= upto - (SELECT size FROM light l2 WHERE l2.key = light.key)) AS shard FROM light
  UNION ALL SELECT key, i - 1 FROM lead WHERE key IS NOT NULL),
crc_table AS (
  SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256))::UBIGINT AS n)),
crcs AS (
  SELECT key, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])))::BIGINT AS text_crc32
  FROM (SELECT key, any_value(text) AS text, hex(encode(any_value(text))) AS hexed FROM sized GROUP BY key), crc_table)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, key) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN placed USING (key) JOIN crcs USING (key)
"""



def _found(term: str, of: str) -> str:
    """Whether a term of the URL filter's vocabulary stands in a URL, or between digits in its host."""
    if term >= UNSPACED:
        return f"contains({of}, '{term}')"
    return rf"(regexp_matches({of}, '(^|[^\pL\pN]){term}([^\pL\pN]|$)') OR regexp_matches({of}_host, '(^|[^\pL\pN]|\d){term}([^\pL\pN]|\d|$)'))"


_CERTAIN = " OR ".join(_found(term, "whole") for term in STRICT if term not in AMBIGUOUS)
_DOUBTFUL = " OR ".join(_found(term, "whole") for term in sorted(AMBIGUOUS))
_SOFTENED = " + ".join(f"{AMBIGUOUS_WEIGHT} * {_found(term, 'low')}::INT" for term in sorted(AMBIGUOUS))
_HARMLESS = " OR ".join(_found(word, "low") for word in sorted(HARMLESS))
_SOFT = " + ".join(f"{weight} * {_found(term, 'low')}::INT" for term, weight in SOFT.items())

#: But for ``xn--`` labels, which SQL can't decode.
OP3 = rf"""
WITH cut AS (
  SELECT page_id, lower(coalesce(try(url_decode(bare)), bare)) AS low, lower(coalesce(try(url_decode(url)), url, '')) AS whole,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, regexp_replace(coalesce(url, ''), '{TRACKING}', '\1', 'g') AS bare FROM pages)),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for verdict, rule in RULES)}) t(rule, rule_host, rule_path, verdict)),
fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS rule_verdict
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
hosts AS (
  SELECT *, regexp_extract(low, '://([^/?#]*)', 1) AS low_host, regexp_extract(whole, '://([^/?#]*)', 1) AS whole_host FROM cut),
told AS (SELECT *, ({_HARMLESS}) AS is_harmless FROM hosts),
hits AS (
  SELECT page_id, {_SOFT} + CASE WHEN is_harmless THEN {_SOFTENED} ELSE 0 END AS soft_weight, ({_CERTAIN}) OR NOT is_harmless AND ({_DOUBTFUL}) AS is_strict FROM told)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN is_strict OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       soft_weight::INT AS soft_weight
FROM cut LEFT JOIN fits USING (page_id) JOIN hits USING (page_id)
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1, "op3_url_filter": OP3, "op4_exact_dedup": OP4, "op5_sharding": OP5}
