"""Common table expressions that the SQL twins share. They follow the definitions, not the Spark plans."""

from __future__ import annotations


def mb(n: str, total: str) -> str:
    return f"round(-log2(({n} + 0.5) / ({total} + 128.0)) * 1000000)::BIGINT"


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

#: Byte counts by (stream, chunk of 512 bytes, byte value); streams are sources in order of doc_id.
COUNTS = """
raw AS (SELECT source AS stream, doc_id, encode(coalesce(text, '')) AS data FROM documents),
placed AS (
    SELECT stream, doc_id, hex(data) AS hx, octet_length(data) AS len,
        sum(octet_length(data)) OVER (PARTITION BY stream ORDER BY doc_id) - octet_length(data) AS start
    FROM raw
),
bytes_at AS (
    SELECT stream, (start + i)::BIGINT AS pos, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INTEGER AS sym
    FROM (SELECT stream, hx, start, unnest(range(len)) AS i FROM placed)
),
cnt AS (SELECT stream, pos // 512 AS chunk, sym, count(*)::BIGINT AS c FROM bytes_at GROUP BY ALL)
"""

PRIOR = """
prior_sym AS (
    SELECT ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INTEGER AS sym, count(*)::DOUBLE AS prior_n
    FROM (SELECT hex(encode(text)) AS hx, unnest(range(octet_length(encode(text)))) AS i FROM benchmark) GROUP BY 1
),
prior_all AS (SELECT sum(prior_n) AS prior_total FROM prior_sym)
"""


def states(strength: float = 1.0, all_seen: bool = False) -> str:
    if all_seen:
        n = f"{strength} * (k * coalesce(sum(c) OVER w, 0) - coalesce(sum(c * k) OVER w, 0))"
        seen = f"{strength} * (k * coalesce(sum(bytes) OVER w, 0) - coalesce(sum(bytes * k) OVER w, 0))"
    else:
        n, seen = f"{strength} * coalesce(sum(c) OVER w, 0)", f"{strength} * coalesce(sum(bytes) OVER w, 0)"
    return f"""
ic AS (SELECT stream, chunk // 4 AS k, sym, sum(c)::BIGINT AS c FROM cnt GROUP BY ALL),
iv AS (
    SELECT *, ({seen})::DOUBLE AS seen FROM (SELECT stream, chunk // 4 AS k, sum(c)::BIGINT AS bytes, count(DISTINCT chunk)::BIGINT AS chunks FROM cnt GROUP BY ALL)
    WINDOW w AS (PARTITION BY stream ORDER BY k {_BEFORE})
),
nn AS (SELECT *, ({n})::DOUBLE AS n FROM ic WINDOW w AS (PARTITION BY stream, sym ORDER BY k {_BEFORE})),
st AS (SELECT nn.*, bytes, chunks, seen FROM nn JOIN iv USING (stream, k))
"""


def costs(strength: float = 1.0) -> str:
    s = strength
    return f"""
co AS (
    SELECT s.stream, s.k, any_value(s.bytes) AS bytes, any_value(s.chunks) AS chunks, any_value(s.chunks) < 4 AS is_tail,
        sum(s.c * {mb("s.n", "s.seen")})::BIGINT AS pre, sum(s.c * {mb("0", "0")})::BIGINT AS base,
        sum(s.c * {mb(f"s.n + {s} * s.c", f"s.seen + {s} * s.bytes")})::BIGINT AS post,
        CASE WHEN any_value(p.bytes) IS NOT NULL THEN sum(s.c * {mb(f"s.n - {s} * coalesce(q.c, 0)", f"s.seen - {s} * p.bytes")})::BIGINT END AS prev
    FROM st s LEFT JOIN iv p ON p.stream = s.stream AND p.k = s.k - 1
    LEFT JOIN ic q ON q.stream = s.stream AND q.k = s.k - 1 AND q.sym = s.sym
    GROUP BY s.stream, s.k
)
"""


GK = """
gk AS (
    SELECT stream AS run, k AS phase, bytes AS curr_bytes, pre / 1e6 AS curr_pre, post / 1e6 AS curr_post, base / 1e6 AS curr_base,
        lead(bytes) OVER w AS next_bytes, lead(prev) OVER w / 1e6 AS next_pre, lead(pre) OVER w / 1e6 AS next_post
    FROM co WINDOW w AS (PARTITION BY stream ORDER BY k)
),
bd AS (SELECT *, next_pre - next_post AS g, curr_pre - curr_post AS din, curr_pre - curr_base AS regret FROM gk WHERE next_bytes IS NOT NULL)
"""


def query(*parts: str, select: str) -> str:
    return fixed(("WITH " + ",\n".join(p.strip() for p in parts) + "\n" if parts else "") + select)


def fixed(sql: str) -> str:
    """round(x, 6) as floor(x * 1e6 + 0.5) / 1e6: engines' own rounding differs on ties."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        new = f"(floor(({inner[:-3]}) * 1e6 + 0.5) / 1e6)" if inner.endswith(", 6)"[:-1]) else f"ROUND({inner})"
        sql = sql[:at] + new + sql[end:]
    return sql


def q6(column):
    """The same on the Spark side."""
    from pyspark.sql import functions as F

    return F.floor(column.cast("double") * 1e6 + 0.5) / 1e6
