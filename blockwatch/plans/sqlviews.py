"""DuckDB SQL for the oracle side: the same views as ``sources.views``, as CTEs.

``with_ctes(body, *names)`` prepends the named CTEs and everything they depend on,
so each oracle query is a single self-contained statement over the driver's tables.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {parts},\n{stripped[5:]}"
    return f"WITH {parts}\n{body}"


cte("v_lines", """
SELECT event_id AS line_no, ts, user_id, event_type, k,
       CASE WHEN event_type = 'error' AND (k < 3 OR value > 200) THEN 'FAIL' ELSE '-' END AS label,
       event_type || ':' || k AS template_id,
       event_type || ':' || (k // 25) AS coarse,
       event_type || ' user ' || user_id || ' k ' || k AS content,
       row_number() OVER (ORDER BY ts, event_id) - 1 AS pos
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")

cte("v_lines_gap", """
SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY pos // 20 ORDER BY pos) AS gap_us
FROM v_lines""", "v_lines")

cte("v_blocks20", """
SELECT pos // 20 + 1 AS block_id,
       CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
       count(*) AS n_lines, min(pos) AS first_pos,
       list(template_id ORDER BY pos) AS event_list,
       string_agg(coalesce(gap_us, 0)::VARCHAR, ',' ORDER BY pos) AS intervals_us,
       string_agg(content, ' | ' ORDER BY pos) AS content
FROM v_lines_gap GROUP BY 1""", "v_lines_gap")

cte("v_blocks100", """
SELECT pos // 100 + 1 AS block_id,
       CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
       count(*) AS n_lines, min(pos) AS first_pos,
       list(template_id ORDER BY pos) AS event_list,
       string_agg(coalesce(gap_us, 0)::VARCHAR, ',' ORDER BY pos) AS intervals_us,
       string_agg(content, ' | ' ORDER BY pos) AS content
FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY pos // 100 ORDER BY pos) AS gap_us
      FROM v_lines) GROUP BY 1""", "v_lines")

cte("v_session_keys", """
SELECT user_id, CAST(ts AS DATE) AS day, min(pos) AS first_pos,
       row_number() OVER (ORDER BY min(pos)) AS block_id
FROM v_lines GROUP BY 1, 2""", "v_lines")

cte("v_session_lines", """
SELECT l.*, s.block_id,
       epoch_us(l.ts) - lag(epoch_us(l.ts)) OVER (PARTITION BY s.block_id ORDER BY l.pos) AS gap_us
FROM v_lines l JOIN v_session_keys s ON l.user_id = s.user_id AND CAST(l.ts AS DATE) = s.day""",
    "v_session_keys")

cte("v_sessions", """
SELECT block_id,
       CASE WHEN bool_and(coalesce(label = '-', false)) THEN 'success' ELSE 'fail' END AS status,
       count(*) AS n_lines, min(pos) AS first_pos,
       list(coarse ORDER BY pos) AS event_list,
       string_agg(coalesce(gap_us, 0)::VARCHAR, ',' ORDER BY pos) AS intervals_us,
       string_agg(content, ' | ' ORDER BY pos) AS content
FROM v_session_lines GROUP BY 1""", "v_session_lines")

cte("v_raw", """
SELECT line_no,
       CASE WHEN k = 99 THEN '    at ' || content
            ELSE (CASE WHEN label = '-' THEN '-' || (CASE WHEN k = 94 THEN chr(160) ELSE ' ' END) ELSE '' END)
                 || strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' [user-' || user_id || '] '
                 || (CASE WHEN k = 98 THEN 'FATAL'
                          WHEN event_type = 'error' THEN 'ERROR'
                          WHEN event_type = 'purchase' THEN 'WARN'
                          WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END)
                 || ' ' || content || (CASE WHEN k = 97 THEN chr(133) || 'tail' WHEN k = 96 THEN chr(8232) || 'tail' ELSE '' END)
            END AS value
FROM v_lines""", "v_lines")

cte("v_vec", """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN label >= 2 THEN 1 ELSE 0 END AS label
FROM embeddings""")
