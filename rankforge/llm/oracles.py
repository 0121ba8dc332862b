"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from rankforge.llm import sharding

# CRC-32 of a text's UTF-8 bytes; the table is built from the reflected polynomial
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c // 2, (c % 2) * 3988292384)) AS c
        FROM range(256) r(n))
)"""


def _crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {data}), "
        "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    )


def _sharding(shards: int = 16, seed: int = 42) -> str:
    keys = ", ".join(map(str, sharding.round_keys(seed)))
    low, (m1, m2) = 4294967295, sharding.MULTIPLIERS
    rounds = sharding.ROUNDS
    # the side that is read, plus the key of the round
    h0 = f"(((CASE WHEN j % 2 = 0 THEN r ELSE l END) + [{keys}][j + 1]) & {low})"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
placed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, text,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text) NULLS FIRST) - 1 AS row_number
  FROM documents
),
sides AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
  FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM documents))
),
walk AS (
  SELECT row_number, n, a, b, row_number % a AS l, row_number // a AS r, 0 AS j, false AS moved
  FROM placed, sides
  UNION ALL
  SELECT row_number, n, a, b,
         CASE WHEN j % 2 = 0 THEN (l + h) % a ELSE l END, CASE WHEN j % 2 = 1 THEN (r + h) % b ELSE r END,
         (j + 1) % {rounds}, true
  FROM (
    SELECT *, xor(h3, h3 >> 16) AS h FROM (
      SELECT *, (xor(h2, h2 >> 15) * {m2}) & {low} AS h3 FROM (
        SELECT *, (xor(h1, h1 >> 16) * {m1}) & {low} AS h2 FROM (
          SELECT *, {h0} AS h1 FROM walk WHERE NOT moved OR j > 0 OR l + a * r >= n)))
  )
),
ended AS (SELECT row_number, l + a * r AS position FROM walk WHERE moved AND j = 0 AND l + a * r < n)
SELECT doc_id, size, {_crc32("text")} AS text_crc32, 'rows' AS law, CAST(position % {shards} AS INTEGER) AS shard,
       position // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number, position
FROM placed JOIN ended USING (row_number), crc_table
"""


def all_sql() -> dict[str, str]:
    return {"op11_sharding": _sharding()}
