"""DuckDB SQL of the newer queries, written from their contracts."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string that is not empty."""
    byte = "lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce([4294967295] || [ord(c) FOR c IN string_split({text}, '')], {byte}), 4294967295)"


def _tree(rows: str, name: str, group: str, levels: int) -> str:
    """CTEs ``{name}{levels}(group, i, h, n, ...)`` with the columns of ``rows(group, i, h, f, n, ...)``: h becomes the root, f the root from f, sib grows."""
    out = [f"{name}0 AS (SELECT * FROM {rows})"]
    for k in range(levels):
        a = f"{name}{k}"
        out.append(
            f"""{a}p AS (SELECT {group}, i // 8 AS p, list(h ORDER BY i) AS hs FROM (SELECT DISTINCT {group}, i, h FROM {a} WHERE n > 1) GROUP BY ALL),
            {a}j AS (SELECT r.*, p.hs FROM {a} r LEFT JOIN {a}p p ON r.{group} IS NOT DISTINCT FROM p.{group} AND r.i // 8 = p.p AND r.n > 1),
            {name}{k + 1} AS (SELECT * EXCLUDE (hs) REPLACE (
                i // 8 AS i, (n + 7) // 8 AS n,
                CASE WHEN hs IS NULL THEN h ELSE sha256(array_to_string(hs, '')) END AS h,
                CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(hs[:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], '')) END AS f,
                CASE WHEN hs IS NULL THEN sib ELSE sib || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') END AS sib
            ) FROM {a}j)"""
        )
    return ",\n".join(out)


def merkle_manifest(levels: int = 8, upper: int = 2) -> str:
    """For groups of up to 8 ** levels rows and up to 8 ** upper groups."""
    value = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    h = lambda text: "sha256(" + " || ".join(value(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH d AS (
            SELECT doc_id, lang, {h("text")} AS leaf, {h(low)} AS low, coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS bad FROM documents
        ), l AS (
            SELECT doc_id, lang, leaf, leaf AS h, CASE WHEN bad THEN low ELSE leaf END AS f, '' AS sib,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
            FROM d
        ), {_tree("l", "t", "lang", levels)}, s AS (
            SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang, h FROM t{levels})
        ), u AS (
            SELECT doc_id, t.lang, leaf, t.h AS subroot, s.h, f, sib, s.i, s.n, 0 AS one FROM t{levels} t JOIN s ON t.lang IS NOT DISTINCT FROM s.lang
        ), {_tree("u", "v", "one", upper)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = h AS verified FROM v{upper}
    """


def url_filters(steps: int = 20) -> str:
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"regexp_extract({x}, '^(?s:.*?)://([^/?#]*)', 1)")
    mass, on, part = 10**15, 85, 10
    link = r"""(?i)<a[ \t\r\n\f](?:[^<>]*[ \t\r\n\f"''])?href[ \t\r\n\f]*=[ \t\r\n\f]*["'']?[ \t\r\n\f]*((?:[a-z][a-z0-9+.-]*:)?//[^"''<> \t\r\n\f]*)"""
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    rounds = "".join(
        f""", r{k + 1} AS MATERIALIZED (
            SELECT kind, host, seed, seed * {100 - on} // 100 + coalesce((SELECT sum(m.mass * {on} // 100 // w.degree) FROM w JOIN r{k} m ON m.kind = w.kind AND m.host = w.a WHERE w.kind = n.kind AND w.b = n.host), 0) AS mass
            FROM r{k} n
        )"""
        for k in range(steps)
    )
    return f"""
        WITH p AS (
            SELECT page_id, html, coalesce({host("url")}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), rules(h, p, v) AS (VALUES {values}), x AS (
            SELECT DISTINCT host, path FROM p
        ), f AS (
            SELECT host, path, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(v, length(h || rules.p)) AS v
            FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY ALL
        ), seeds AS (
            SELECT host, count(*) FILTER (v = 'allow') AS allowed, count(*) FILTER (v = 'block') AS blocked
            FROM p LEFT JOIN f USING (host, path) WHERE host <> '' GROUP BY host
        ), l AS (
            SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p
        ), e AS (
            SELECT DISTINCT src, {host("CASE WHEN link LIKE '//%' THEN 'x:' || link ELSE link END")} AS dst FROM l
        ), way AS (
            SELECT 'trust' AS kind, src AS a, dst AS b FROM e WHERE src <> '' AND dst <> '' AND src <> dst
            UNION ALL SELECT 'distrust', dst, src FROM e WHERE src <> '' AND dst <> '' AND src <> dst
        ), w AS MATERIALIZED (
            SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM way
        ), s AS (
            SELECT 'trust' AS kind, host, allowed AS n FROM seeds UNION ALL SELECT 'distrust', host, blocked FROM seeds
        ), n AS (
            SELECT kind, a AS host FROM w UNION SELECT kind, b FROM w UNION SELECT kind, host FROM s
        ), r0 AS MATERIALIZED (
            SELECT n.kind, n.host, coalesce(CAST(s.n AS HUGEINT) * {mass} // nullif(sum(s.n) OVER (PARTITION BY n.kind), 0), 0) AS seed, seed AS mass FROM n LEFT JOIN s ON s.kind = n.kind AND s.host = n.host
        ){rounds}, bad AS (
            SELECT host FROM r{steps} GROUP BY host
            HAVING sum(mass) FILTER (kind = 'distrust') > sum(mass) FILTER (kind = 'trust')
               AND sum(mass) FILTER (kind = 'distrust') > {mass} // ({part} * (SELECT count(DISTINCT host) FROM r0))
        )
        SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN p.host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN f ON f.host = p.host AND f.path = p.path
    """


def conversation_repair() -> str:
    """The lattice row by row: the least (cost, audit) and the repaired text to each of four states, in a recursion."""
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    go = lambda x, cost, letter, line: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {x}.r || {line}}} END"
    user, assistant = (lambda x: go(x, 3, "I", "'user:' || chr(10)")), (lambda x: go(x, 3, "I", "'assistant:' || chr(10)"))
    kept = lambda x, initial: f"CASE WHEN fault IN (0, 3) AND role[1] = '{initial}' THEN {go(x, 'more', 'K', 'role || chr(58) || text || chr(10)')} END"
    turned = lambda x, role: f"CASE WHEN fault IN (0, 3) THEN {go(x, '3 + more', 'R', f"'{role}:' || text || chr(10)")} END"
    gone = lambda x: go(x, 4, "D", "''")
    inserted = lambda source: f"SELECT *, {least('p3', assistant('p2'))} AS q3 FROM (SELECT *, {least('s2', user('s0'), user('s1'), user('s3'))} AS p2, s3 AS p3 FROM {source})"
    before_u = least("s0", "s1", "q3")
    return f"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
            FROM conversations
        ), d AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM c, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
        ), o AS (
            SELECT *, row_number() OVER w AS i,
                regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS last, lag(role[1]) OVER w || role[1] AS pair
            FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), f AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM o
        ), facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM f GROUP BY conv_id
        ), s AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s1, s1 AS s2, s1 AS s3 FROM c
            UNION ALL
            SELECT conv_id, i, {gone("s0")}, {least(gone("s1"), kept("s0", "s"))}, {least(gone("p2"), kept("before", "u"), turned("before", "user"))}, {least(gone("q3"), kept("p2", "a"), turned("p2", "assistant"))}
            FROM (SELECT *, {before_u} AS before FROM ({inserted("(SELECT f.*, s0, s1, s2, s3 FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)")}))
        ), best AS (
            SELECT conv_id, {least("s0", "q3")} AS b FROM ({inserted("(SELECT s.* FROM s LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = coalesce(n, 0))")})
        )
        SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            b.c AS cost, b.a AS audit, sha256(CASE WHEN b.r = '' THEN '' ELSE left(b.r, length(b.r) - 1) END) AS repaired_sha256
        FROM best LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id
    """
