"""CRC-32 in DuckDB's SQL, which has no function for it."""

#: CTE crc(t): the table of the reflected polynomial, by a rule.
CRC = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"


def crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of bytes, in a query that reads ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b::BIGINT) & 255) + 1])), 4294967295)"


def latin_bytes(text: str) -> str:
    """UTF-8 bytes of a string without code points above U+00FF."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END))"
