"""The queries that SQL can express, written a second time for another engine."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    lowered = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP2 = """
WITH m AS (
    SELECT conv_id, CAST(coalesce(floor(turn / 256), 0) AS BIGINT) AS part, turn,
           replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
           replace(coalesce(text, ''), '<|', '< |') AS content
    FROM conversations WHERE conv_id IS NOT NULL),
sides AS (
    SELECT conv_id, part, speaker FROM (SELECT DISTINCT conv_id, part FROM m) p
    JOIN (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system') s USING (conv_id)),
lines AS (
    SELECT s.conv_id, s.part, s.speaker, m.role, m.content,
           '<|im_start|>' || CASE WHEN m.role = 'system' THEN 'system'
               WHEN m.role = s.speaker THEN 'assistant' ELSE 'user name=' || m.role END || chr(10)
               AS head,
           row_number() OVER (PARTITION BY s.conv_id, s.part, s.speaker
                              ORDER BY m.turn NULLS FIRST, m.role, m.content) AS k
    FROM sides s JOIN m ON m.conv_id = s.conv_id AND m.part = s.part),
placed AS (
    SELECT *, CAST(sum(length(head) + length(content) + 11) OVER (
        PARTITION BY conv_id, part, speaker ORDER BY k) AS BIGINT) - 11 AS stop
    FROM lines)
SELECT conv_id, part, speaker, count(*) AS n_messages,
       string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg((stop - length(content)) || ':' || stop, ',' ORDER BY k)
                FILTER (WHERE role = speaker), '') AS spans
FROM placed GROUP BY 1, 2, 3
"""

OP6 = f"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS size,
           array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS s
    FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(k) WHERE len(w) > 0),
doc AS (
    SELECT row_number() OVER () AS row, doc_id, {_words("coalesce(text, '')")} AS w
    FROM documents),
place AS (
    SELECT row, size, k, array_to_string(w[k : k + size - 1], ' ') AS s
    FROM doc, (SELECT DISTINCT size FROM windows) z, unnest(range(1, len(w) - size + 2)) t(k)),
hit AS (SELECT DISTINCT row, size, k, item FROM place JOIN windows USING (size, s)),
hits AS (
    SELECT row, count(DISTINCT h) AS n_hit FROM hit, unnest(range(k, k + size)) t(h) GROUP BY 1),
items AS (
    SELECT row, count(DISTINCT item) AS n_items,
           string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""

# Fixed patterns: kind, pattern, group of the value, its least length.
_KINDS = (
    (
        "assign",
        "(?i:(password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("vendor", "(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("signed", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\s]+", 0, 40),
)


def _found(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT row, doc_id, source, {no} AS no, '{kind}' AS kind, value,
           CAST(list_sum(list_transform(gap[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0)
                AS BIGINT) AS start, length(whole[i]) AS size
    FROM (SELECT *, val[i] AS value FROM (
        SELECT *, string_split_regex(text, '{pattern}') AS gap,
               regexp_extract_all(text, '{pattern}', 0) AS whole,
               regexp_extract_all(text, '{pattern}', {group}) AS val
        FROM doc WHERE regexp_matches(text, '{pattern}')) a, unnest(range(1, len(whole) + 1)) t(i)) b
    WHERE length(value) >= {least}"""


OP7 = f"""
WITH doc AS (
    SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_found(k, *kind) for k, kind in enumerate(_KINDS))}),
owned AS (
    SELECT value, n_owners, n_repos, n_owners >= 3 OR (n_owners >= 2 AND n_repos >= 8) AS example
    FROM (SELECT value, count(DISTINCT coalesce(source, chr(0) || 'null')) AS n_owners,
                 count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')) AS n_repos
          FROM found GROUP BY 1)),
each AS (
    SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
           count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, no)
               FILTER (WHERE no < 3) AS base,
           string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, no) AS spans,
           count(*) FILTER (WHERE NOT example) AS n_live,
           count(*) FILTER (WHERE example) AS n_example,
           max(n_owners) AS max_owners, max(n_repos) AS max_repos
    FROM found JOIN owned USING (value) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners,
       coalesce(max_repos, 0) AS max_repos
FROM doc LEFT JOIN each USING (row)
"""

OP11 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
    SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a,
           CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                     OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90
                THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
cut AS (
    SELECT *, least(a, b) AS i, greatest(a, b) AS j, left(text, least(a, b)) AS p,
           substring(text, least(a, b) + 1, abs(a - b)) AS m,
           substring(text, greatest(a, b) + 1, n) AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

ORACLE: dict[str, str] = {
    "op2_chat": OP2,
    "op6_decontamination": OP6,
    "op7_secrets": OP7,
    "op11_infill": OP11,
}
