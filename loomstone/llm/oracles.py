"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import math

from loomstone.llm import license_scan, sharding

_WHITE = r"[\x09-\x0D ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sharding_sql(shards: int = 8, seed: int = 0) -> str:
    """op3: each recursion is one round of the network, for the rows that haven't landed inside after a whole pass.

    A CRC is a fold over a text's bytes with a table of the remainders of all 256 byte values.
    """
    keys = "[" + ", ".join(f"{k}::UHUGEINT" for k in sharding._keys(seed)) + "]"
    wrap = "18446744073709551616::UHUGEINT"
    return f"""
WITH RECURSIVE total AS (SELECT count(*) AS n FROM documents),
shape AS (SELECT n, (bits // 2)::UHUGEINT AS low, (bits - bits // 2)::UHUGEINT AS high FROM (SELECT n, greatest(1, CASE WHEN n <= 1 THEN 0 ELSE CAST(floor(log2(n - 1)) AS INTEGER) + 1 END) AS bits FROM total)),
numbered AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents),
walk(i, x, r) AS (
  SELECT i, i::UHUGEINT, 0 FROM numbered
  UNION ALL
  SELECT i, CASE WHEN r % 2 = 1 THEN xor(x, (f >> (64::UHUGEINT - high)) << low) WHEN low = 0 THEN x ELSE xor(x, f >> (64::UHUGEINT - low)) END, r + 1 FROM (
    SELECT *, xor(c, c >> 31::UHUGEINT) AS f FROM (
      SELECT *, (xor(b, b >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % {wrap} AS c FROM (
        SELECT *, (xor(a, a >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % {wrap} AS b FROM (
          SELECT i, x, r, n, low, high, ((CASE WHEN r % 2 = 1 THEN x % (1::UHUGEINT << low) ELSE x >> low END) + list_extract({keys}, r % {sharding.ROUNDS} + 1)) % {wrap} AS a
          FROM walk, shape WHERE r % {sharding.ROUNDS} <> 0 OR r = 0 OR x >= n))))
),
landed AS (SELECT i, arg_max(x, r) AS p FROM walk GROUP BY i),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(b)))
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INTEGER) + 1], c >> 8))) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN landed USING (i), crc_table
"""


def jaccard_sql() -> str:
    """op6: shared shingles of every two documents that share one, then the least id that links reach."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WHITE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
token AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM token a JOIN token b ON a.t = b.t AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM shared WHERE 100 * common >= 90 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT z.doc_id, z.n AS n_shingles, least(z.doc_id, coalesce(min(r.other), z.doc_id)) AS component_id FROM sizes z LEFT JOIN reach r ON r.doc_id = z.doc_id GROUP BY z.doc_id, z.n
"""


def license_sql() -> str:
    """op8: phrases by place, templates by the containment of their tokens in each line or paragraph."""
    break_ = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '{break_}'), lambda x: x <> '')"
    phrase = " ".join(f"WHEN {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(p))} THEN '{label}'" for p, label in license_scan.PHRASES.items())
    rows = []
    for label, unit, wording in license_scan.TEMPLATES:
        tokens = license_scan.template_tokens(wording)
        need = max(1, math.ceil(round(license_scan.THRESHOLDS[unit] * len(tokens), 9)))
        rows.append(f"('{label}', '{unit}', [{', '.join(repr(t) for t in tokens)}], {need})")
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
word AS (SELECT doc_id, low, {words('low')} AS w FROM low),
place AS (SELECT doc_id, i - 1 AS i, CASE {phrase} END AS label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM word)),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM place WHERE label IS NOT NULL GROUP BY doc_id),
template(label, unit, tokens, need) AS (VALUES {', '.join(rows)}),
block AS (SELECT doc_id, 'line' AS unit, unnest(string_split(low, chr(10))) AS b FROM low UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(low, '\\n[\\x09-\\x0D ]*\\n')) FROM low),
held AS (SELECT doc_id, label, len(list_intersect(tokens, {words('b')})) AS k, len(tokens) AS n, need FROM block JOIN template USING (unit) WHERE length(b) > 0),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(k::DOUBLE / n) AS part FROM held WHERE k >= need GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.part, 0.0::DOUBLE) END AS score
FROM word w LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
