"""SQL of queries that are registered without any: what the functions mean, put in another way."""

from __future__ import annotations

#: Length of the longest non-decreasing subsequence of a list named by "a".
LONGEST = "len(list_reduce(list_concat([[]::BIGINT[]], list_transform({a}, lambda v: [v::BIGINT])), lambda t, x: list_concat(list_concat(list_filter(t, lambda y: y <= x[1]), x), list_filter(t, lambda y: y > x[1])[2:])))"

def _greedy_rows(tolerance: float) -> str:
    """Rows of words as a list that each step of the recursion adds one word to."""
    return f"""WITH RECURSIVE w AS (SELECT label AS page, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, round(embedding[2]::DOUBLE * 1000) AS m, (vec_id % 40 + 10)::DOUBLE AS h, round(embedding[1]::DOUBLE * 1000) AS v, vec_id::VARCHAR AS t FROM embeddings),
        z AS (SELECT page, i, ((m + h / 2) + (m - h / 2)) / 2 AS y, {{'x': v - h, 'i': i, 't': t}} AS word FROM w),
        f AS (SELECT DISTINCT page, 0::BIGINT AS i, []::STRUCT(s DOUBLE, n INT, w STRUCT(x DOUBLE, i BIGINT, t VARCHAR)[])[] AS rows FROM z
            UNION ALL SELECT page, i, CASE WHEN home > 0 THEN list_transform(rows, lambda r, k: CASE WHEN k = home THEN {{'s': r.s + y, 'n': r.n + 1, 'w': list_append(r.w, word)}} ELSE r END) ELSE list_append(rows, {{'s': y, 'n': 1, 'w': [word]}}) END
            FROM (SELECT z.*, f.rows, coalesce(list_position(list_transform(f.rows, lambda r: abs(r.s / r.n - z.y) <= {tolerance}), true), 0) AS home FROM f JOIN z ON z.page = f.page AND z.i = f.i + 1)),
        l AS (SELECT page, arg_max(rows, i) AS rows FROM f GROUP BY page)
        SELECT page, k::INT - 1 AS row, rows[k].s / rows[k].n AS y, array_to_string(list_transform(list_sort(rows[k].w), lambda x: x.t), ' ') AS text FROM (SELECT page, rows, unnest(range(1, len(rows) + 1)) AS k FROM l)"""


SQL_APART: dict[str, str] = {
    "w10_rebuild_rows": _greedy_rows(12.0),
    "w11_cluster_words": _greedy_rows(4.0),
    "m2_step_sessions": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
        s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, session""",
    "t8_combine_sources": """WITH RECURSIVE r AS (SELECT p_partkey // 40 AS doc, p_partkey, p_partkey % 2 = 1 AS second, p_name || '@' || (p_size % 3) AS text, CASE WHEN p_size % 2 = 0 THEN (p_size % 10)::VARCHAR ELSE '' END AS section,
            row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey % 2, p_partkey) AS i FROM part),
        f AS (SELECT DISTINCT doc, 0::BIGINT AS i, []::BIGINT[] AS kept, []::VARCHAR[] AS texts, []::VARCHAR[] AS sections FROM r
            UNION ALL SELECT doc, i, CASE WHEN seen THEN kept ELSE list_append(kept, p_partkey) END, CASE WHEN seen THEN texts ELSE list_append(texts, text) END, CASE WHEN seen THEN sections ELSE list_append(sections, section) END
            FROM (SELECT r.*, f.kept, f.texts, f.sections, second AND (list_contains(texts, text) OR section <> '' AND list_contains(sections, section)) AS seen FROM f JOIN r ON r.doc = f.doc AND r.i = f.i + 1)),
        l AS (SELECT doc, arg_max(kept, i) AS kept FROM f GROUP BY doc)
        SELECT doc::BIGINT AS doc, (unnest(range(1, len(kept) + 1)) - 1)::INT AS place, unnest(kept) AS p_partkey FROM l""",
    "f33_scripts": r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\p{Greek}') THEN 'GREEK' END, CASE WHEN regexp_matches(text, '\p{Latin}') THEN 'LATIN' END,
        CASE WHEN regexp_matches(regexp_replace(text, '[\p{Greek}\p{Latin}]', '', 'g'), '\p{L}') THEN 'OTHER' END], lambda x: x IS NOT NULL), ',') AS scripts FROM conversations""",
    "f30_fragments_joined": r"""WITH RECURSIVE s AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, 0 AS n FROM conversations
            UNION ALL SELECT conv_id, turn, u, n + 1 FROM (SELECT *, regexp_replace(t, '(^|[^\p{L}\p{N}_])([A-Za-z])\s+([a-z]{2,})($|[^\p{L}\p{N}_])', '\1\2\3\4', 'g') AS u FROM s) WHERE u <> t)
        SELECT conv_id, turn, arg_max(t, n) AS joined FROM s GROUP BY ALL""",
    "f4_repaired_text": r"""SELECT conv_id, turn, trim(regexp_replace(CASE WHEN regexp_full_match(text, '([\x{00}-\x{7f}]|[\x{c2}-\x{df}][\x{80}-\x{bf}]|\x{e0}[\x{a0}-\x{bf}][\x{80}-\x{bf}]|[\x{e1}-\x{ec}\x{ee}\x{ef}][\x{80}-\x{bf}]{2}|\x{ed}[\x{80}-\x{9f}][\x{80}-\x{bf}]|\x{f0}[\x{90}-\x{bf}][\x{80}-\x{bf}]{2}|[\x{f1}-\x{f3}][\x{80}-\x{bf}]{3}|\x{f4}[\x{80}-\x{8f}][\x{80}-\x{bf}]{2})*')
        THEN decode(unhex(array_to_string(list_transform(string_split(text, ''), lambda x: printf('%02x', unicode(x))), ''))) ELSE coalesce(text, '') END, '\s+', ' ', 'g')) AS repaired FROM conversations""",
    "p33_encoding_blocks": """WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 2 = 0 THEN replace(p_name, 'i', 'l') ELSE p_name END AS b FROM part),
        w AS (SELECT *, string_split(b, '') AS y FROM p),
        d AS (SELECT p_partkey, a, b, list_reduce(list_concat([[0 FOR j IN range(len(y) + 1)]], list_transform(string_split(a, ''), lambda ch: [CASE WHEN k > 0 AND y[k] = ch THEN 1 ELSE 0 END FOR k IN range(len(y) + 1)])),
            lambda row, hit: [list_max([CASE WHEN hit[i] = 1 THEN row[i - 1] + 1 ELSE row[i] END FOR i IN range(1, j + 1)]) FOR j IN range(1, len(row) + 1)])[-1] AS common FROM w)
        SELECT p_partkey, 2 * common >= 0.94 * (length(a) + length(b)) AND length(b) <= 128 AND len(string_split(b, ' ')) <= 10 AS apply FROM d""",
}
