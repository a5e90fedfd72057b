"""DuckDB SQL with the results of queries of this subpackage that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(ch)::BIGINT for ch in string_split({text}, '')]),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
            lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""


# Nodes are named by the digests of their turns side by side, so an ancestor's name begins its descendants'.
PREFIXTRIE = f"""WITH t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, count(*) AS n, {_crc32("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
    r AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
    turns AS (
        SELECT r.conv_id, place, role, text FROM r JOIN t ON t.conv_id = r.base WHERE place < h
        UNION ALL SELECT r.conv_id, place - h + taken, role, text FROM r JOIN t ON t.conv_id = r.conv_id WHERE place >= h),
    paths AS (
        SELECT conv_id, place + 1 AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
            string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS node FROM turns),
    members AS (
        SELECT conv_id, 0 AS depth, 0 AS words, '' AS node, NULL AS parent FROM r
        UNION ALL SELECT conv_id, depth, words, node, left(node, length(node) - 32) FROM paths),
    nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words,
            min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY node),
    counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children
        FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) k ON k.parent = n.node),
    sums AS (SELECT a.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
        FROM counted a JOIN counted u ON starts_with(u.node, a.node) GROUP BY a.node),
    ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, max_by(node, depth) AS node FROM members GROUP BY conv_id) GROUP BY node)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
        saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM counted n JOIN sums USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN ends ON ends.node = n.node"""

# States of the grammar: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's.
_INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
_KEEP = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}


def _pair(cost: str, edit: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'e': '{edit}' || {state}.e}}"


def _least(options: list[str]) -> str:
    return f"list_min([{', '.join(options)}])"


def _consumed(q: int) -> str:
    """The best way on from state ``q`` if the next edit takes the turn: it is deleted, kept or renamed."""
    kept = " ".join(f"WHEN NOT gone AND starts_with(role, '{x}') THEN {_pair('extra', 'K', f'v{to}')}" for x, to in _KEEP[q])
    renamed = f"CASE WHEN NOT gone THEN {_pair('extra + 3', 'R', f'v{_INSERT[q]}')} END"
    return _least([_pair("4", "D", f"v{q}"), f"CASE {kept} END", renamed])


def _inserted(q: int, w: str) -> str:
    """The best way on from state ``q`` with up to two inserted turns before the next."""
    once, twice = _INSERT[q], _INSERT[_INSERT[q]]
    return _least([f"{w}{q}", _pair("3", "I", f"{w}{once}"), _pair("6", "II", f"{w}{twice}")])


_END = {0: "{'c': 0, 'e': ''}", 1: "{'c': 1000000000, 'e': ''}", 2: "{'c': 1000000000, 'e': ''}", 3: "{'c': 0, 'e': ''}"}

REPAIR = f"""WITH RECURSIVE hurt AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
        FROM conversations WHERE conv_id IS NOT NULL),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
        FROM hurt, (VALUES (0), (1)) copies(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
            lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM placed),
    faults AS (SELECT *, CASE WHEN shown = '' THEN 1 WHEN again THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (following IS NOT NULL AND left(role, 1) || following NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY conv_id),
    best AS (
        SELECT conv_id, n AS i, {", ".join(f"{_inserted(q, 'w')} AS v{q}" for q in range(4))}
        FROM counts, (SELECT {", ".join(f"{_END[q]} AS w{q}" for q in range(4))})
        UNION ALL
        SELECT conv_id, i, {", ".join(f"{_inserted(q, 'w')} AS v{q}" for q in range(4))} FROM (
            SELECT conv_id, i - 1 AS i, {", ".join(f"{_consumed(q)} AS w{q}" for q in range(4))}
            FROM (SELECT b.*, f.role, f.fault IN (1, 2) AS gone, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END AS extra
                  FROM best b JOIN faults f ON f.conv_id = b.conv_id AND f.i = b.i))),
    audits AS (SELECT conv_id, v0.c AS cost, v0.e AS audit FROM best WHERE i = 0),
    edits AS (SELECT conv_id, p, substr(audit, p, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
    walked AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o
        FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    turned AS (SELECT w.conv_id, p, o, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
            max(CASE WHEN o = 1 AND edit = 'K' AND starts_with(f.role, 's') THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS sys
        FROM walked w LEFT JOIN faults f ON f.conv_id = w.conv_id AND f.i = w.i),
    lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
            chr(10) ORDER BY p) AS text FROM turned WHERE edit <> 'D' GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
        coalesce(audit, '') AS audit, sha256(coalesce(lines.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c
    LEFT JOIN counts USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN lines USING (conv_id)"""
