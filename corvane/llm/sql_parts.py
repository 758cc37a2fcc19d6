"""Pieces of DuckDB SQL that several oracles need."""


def crc32_tables(lengths: str) -> str:
    """CTEs for crc32 in SQL; `lengths` is a subquery for the longest length in bytes.

    A checksum is the xor of what each byte contributes at its distance from the end, and of the checksum of as many zero
    bytes: crc_t(d, b, v) and crc_z(len, v).
    """
    return f"""
crc_0 AS (SELECT b::BIGINT AS b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)),
crc_top AS (SELECT coalesce({lengths}, 0)::BIGINT AS top),
crc_t(d, b, v) AS (SELECT 0::BIGINT, b, v FROM crc_0 UNION ALL SELECT d + 1, t.b, xor(t.v >> 8, z.v) FROM crc_t t JOIN crc_0 z ON z.b = t.v & 255, crc_top WHERE d < top),
crc_s(len, v) AS (SELECT 0::BIGINT, 4294967295::BIGINT UNION ALL SELECT len + 1, xor(s.v >> 8, z.v) FROM crc_s s JOIN crc_0 z ON z.b = s.v & 255, crc_top WHERE len < top),
crc_z AS (SELECT len, xor(v, 4294967295) AS v FROM crc_s)"""


def crc32_of(source: str, column: str) -> str:
    """A query for (column, crc) over the distinct values of a column of a CTE."""
    return f"""SELECT {column}, xor(any_value(z.v), coalesce(bit_xor(t.v), 0)) AS crc FROM (
  SELECT {column}, strlen({column}) AS n, hex(encode({column})) AS x, unnest(CASE WHEN strlen({column}) = 0 THEN [NULL] ELSE range(strlen({column})) END) AS i FROM (SELECT DISTINCT {column} FROM {source})) s
JOIN crc_z z ON z.len = s.n LEFT JOIN crc_t t ON t.d = s.n - 1 - s.i AND t.b = ('0x' || substr(s.x, 2 * s.i + 1, 2))::BIGINT GROUP BY {column}"""
