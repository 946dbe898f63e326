"""SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from tessera.llm.license_scan import LOWER, NEAR, PHRASES, TEMPLATES, UPPER
from tessera.llm.quality_rules import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM k),
h AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE doc_id > first) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN h ON h.doc_id = w.doc_id"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * k >= 4 * (nx.size + ny.size - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc),
c AS (SELECT doc, min(root) AS class_id FROM r GROUP BY doc),
d AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT doc AS doc_id, class_id, coalesce(links, 0) AS n_links FROM c LEFT JOIN d ON d.x = c.doc"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(r.n, 0) AS n_repeat_words,
      len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 15, true) AND coalesce(n_symbols / n_words <= 0.35, true)
       AND coalesce(n_dup_lines / nullif(len(ls), 0) <= 0.5, true) AND coalesce(n_stop / n_words >= 0.01, true) AS kept FROM f"""

ANY = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}


def either_case(*words: str) -> str:
    """RE2 folds two letters outside of ASCII with k and s, so both cases are written out."""
    return "|".join("".join(ANY.get(c, c) for c in w) for w in words)


ASSIGN = f"(?:{either_case('password', 'passwd', 'secret', 'token')}|{either_case('api')}_?{either_case('key')})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
NAME = f"(?:{either_case('client')}_?{either_case('id')}|{either_case('access')}_?{either_case('key')}_?{either_case('id')}|{either_case('account')}_?{either_case('id')}|{either_case('user')}_?{either_case('name')}|{either_case('user')}|{either_case('login')})" + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@_.-]{3,}"""
TOKEN = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:@/?&=%-]{4,}"


def places(pattern: str, kind: int, role: str, group: int = 0) -> str:
    """Rows (doc_id, kind, role, s, e, v) of a pattern's matches; v is the match or its group."""
    return f"""SELECT doc_id, {kind} AS kind, '{role}' AS role, s, s + length(ms[i]) AS e, gs[i] AS v FROM (SELECT doc_id, ms, gs, i,
CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT doc_id, ps, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs FROM documents WHERE regexp_matches(text, '{pattern}'))))"""


KIND_NAMES = "['assign', 'access', 'hex', 'link_name', 'link_token', 'link_endpoint']"
JOINED = f"string_agg({KIND_NAMES}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"

SECRETS = f"""
WITH a AS ({places(ASSIGN, 0, "secret", 1)} UNION ALL {places("AKIA[A-Z0-9]{14,}", 1, "name")} UNION ALL {places("[0-9a-f]{16,}", 2, "secret")}),
base AS (SELECT doc_id, kind, role, s, e FROM a WHERE kind > 0 OR length(v) >= 12),
k AS ({places(NAME, 3, "name")} UNION ALL {places(TOKEN, 4, "secret")} UNION ALL {places(ENDPOINT, 5, "endpoint")}),
weak AS (SELECT doc_id, kind, role, s, e FROM k WHERE (kind <> 4 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.s < k.e AND k.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (SELECT DISTINCT w.* FROM weak w JOIN every o ON o.doc_id = w.doc_id AND (w.role = 'secret') <> (o.role = 'secret') AND o.s <= w.e + 256 AND w.s <= o.e + 256),
bs AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {JOINED} AS t FROM base GROUP BY doc_id),
sp AS (SELECT doc_id, {JOINED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(t, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN sp ON sp.doc_id = d.doc_id"""

LICENSES = f"""
WITH t(label, words) AS (VALUES {", ".join(f"('{name}', string_split('{text}', ' '))" for name, text in TEMPLATES.items())}),
g AS (SELECT label, len(words) AS n, j AS tpos, words[j + 1:j + 4] AS gram FROM (SELECT label, words, unnest(range(0, len(words) - 3)) AS j FROM t)),
ph(label, words) AS (VALUES {", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
pos AS (SELECT doc_id, p.pos AS pos, p.gram AS gram FROM (SELECT doc_id, unnest(list_transform(range(0, len(ws)), lambda i: {{'pos': i, 'gram': ws[i + 1:i + 4]}})) AS p FROM w)),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM pos JOIN ph ON gram[1:len(words)] = words GROUP BY doc_id),
h AS (SELECT doc_id, label, n, pos - tpos AS d, pos, tpos FROM pos JOIN g USING (gram)),
m AS (SELECT *, CASE WHEN d - lag(d) OVER o <= {NEAR} AND abs(pos - lag(pos) OVER o) <= n THEN 0 ELSE 1 END AS fresh FROM h WINDOW o AS (PARTITION BY doc_id, label ORDER BY d, pos)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY d, pos ROWS UNBOUNDED PRECEDING) AS span FROM m),
r AS (SELECT *, max(tpos) OVER (PARTITION BY doc_id, label, span ORDER BY pos, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
v AS (SELECT doc_id, label, round(sum(CASE WHEN top IS NULL THEN 4 WHEN tpos > top THEN least(4, tpos - top) ELSE 0 END) / any_value(n), 6) AS share FROM r GROUP BY doc_id, label, span),
p AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM v WHERE share >= 0.6 GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(p.labels, []))), ',') AS labels, CASE WHEN b.labels IS NOT NULL THEN 1.0 ELSE coalesce(p.share, 0) END AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN p ON p.doc_id = w.doc_id"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, x, substr(h, 1000 * x + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 99 + 499) // 500)) AS x FROM d WHERE len(h) >= 200)),
w AS (SELECT doc_id, 500 * x + i AS i, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, x, part, unnest(range(0, least(500, len(part) // 2 - 99))) AS i FROM p)),
g AS (SELECT doc_id, i AS s FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS first, row_number() OVER (PARTITION BY m, doc_id ORDER BY i) AS nth FROM w) WHERE first < doc_id OR nth > 1),
f AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM f) GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""

ORACLES = {
    "op2_secret_scan": SECRETS,
    "op3_substring_dedup": SUBSTRING,
    "op5_license_scan": LICENSES,
    "op7_ngram_jaccard_join": JACCARD,
    "op8_quality_rules": QUALITY,
    "op9_suffix_dedup": SUFFIXES,
}
