"""CRC-32 in DuckDB's SQL, for the twins of queries that return one."""

#: a common table expression: the register after each byte, by the usual polynomial
CRC_STEP = """
    step AS (
        SELECT list(c ORDER BY v) AS tab FROM (
            SELECT v, list_reduce([v, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM (SELECT unnest(range(256)) AS v)))"""


def crc32(text: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, where ``step`` is joined."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::BIGINT)),
        lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
