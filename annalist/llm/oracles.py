"""SQL of the queries that SQL can express, for the comparison engine."""

from __future__ import annotations

from annalist.llm import secrets, url_filters

_WORDS = r"[x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') for i in range(1, len(ws) - least(5, len(ws)) + 2)]) gram FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT a id, b root FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.root),
class AS (SELECT id, least(id, min(root)) class_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(class_id, w.doc_id) class_id, (SELECT count(*) FROM link WHERE a = w.doc_id) n_links FROM w LEFT JOIN class ON id = w.doc_id
"""

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in url_filters.BASE_RULES)
OP2 = rf"""
WITH u AS (SELECT page_id, url, lower(coalesce(regexp_extract(url, '^((?s:.*?))://', 1), '')) scheme, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path, coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '') query, lower(coalesce(regexp_extract(url, '^(?s:.*?)://[^#]*#(.*)$', 1), '')) fragment FROM pages),
t AS (SELECT *, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_concat([x for x in ['scheme=' || scheme] if scheme <> ''], ['host=' || x for x in string_split(host, '.') if x <> ''],
  ['path=' || x for x in regexp_split_to_array(regexp_replace(lower(path), '\d+', '0', 'g'), '[/.]+') if x <> ''],
  ['query=' || x for x in [split_part(y, '=', 1) for y in string_split(lower(query), '&')] if x <> ''], [x for x in ['fragment=' || fragment] if fragment <> '']))) ELSE [] END tokens FROM u),
labelled AS MATERIALIZED (SELECT tokens, quality = 0 OR toxic = 1 AS bad FROM t JOIN labels ON doc_id = page_id WHERE url IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL),
sets AS (SELECT [tokens[i] for i in range(1, len(tokens) + 1) if (mask // (1 << (i - 1))) % 2 = 1] items, bad FROM (SELECT tokens, bad, unnest(range(1, 1 << len(tokens))) mask FROM labelled)),
counted AS (SELECT items, count(*) n_rule, count(*) FILTER (bad) n_bad FROM sets GROUP BY 1),
rules AS MATERIALIZED (SELECT items, n_bad / n_rule confidence FROM counted WHERE n_bad >= greatest(3, ceil({url_filters.MIN_SUPPORT} * (SELECT count(*) FROM labelled))) AND n_bad / n_rule >= {url_filters.MIN_CONFIDENCE}),
kept AS MATERIALIZED (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules s WHERE len(s.items) < len(r.items) AND s.confidence >= r.confidence AND list_has_all(r.items, s.items))),
mined AS (SELECT url, max({{'c': confidence, 'r': array_to_string(items, ' ')}}) best FROM (SELECT DISTINCT url, tokens FROM t) JOIN kept ON list_has_all(tokens, items) GROUP BY 1),
base(verdict, h, p) AS (VALUES {_RULES}),
fit AS (SELECT page_id, url, max({{'n': length(h || p), 'rule': h || p, 'verdict': base.verdict}}) b FROM t JOIN base ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT t.page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END) verdict, best.r mined_rule, best.c mined_confidence
FROM t LEFT JOIN fit ON fit.page_id = t.page_id AND fit.url = t.url LEFT JOIN mined ON mined.url = t.url
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') body FROM pages),
d AS (SELECT page_id, strlen(body) payload_bytes, sha256(body) payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END record_type, CASE WHEN first <> page_id THEN first END refers_to FROM f
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _located(kind: str, order: int, pattern: str, keep: str = "true", texts: str = "d") -> str:
    """Matches in texts (doc_id, off, t), offsets counted from off."""
    p = _quoted(pattern)
    return f"""(SELECT doc_id, {order} o, '{kind}' kind, off + s AS s, off + s + length(m) e, m FROM (SELECT doc_id, off, m[k] m,
  cast(coalesce(list_sum([length(x) for x in g[1:k]]), 0) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS bigint) s
  FROM (SELECT doc_id, off, m, g, unnest(range(1, len(m) + 1)) k FROM (SELECT doc_id, off, regexp_extract_all(t, '{p}') m, regexp_split_to_array(t, '{p}') g FROM {texts}))) WHERE {keep})"""


_ALLOWED = " OR ".join(f"regexp_matches(m, '{_quoted(p)}')" for p in secrets.ALLOW)
_W = secrets.WINDOW
_THRESHOLD = "CASE " + " ".join(f"WHEN regexp_matches(m, '{c.pattern}') THEN {c.threshold}" for c in secrets.CLASSES) + " END"


def _hot(tokens: str) -> str:
    """The tokens of which some window reaches the threshold of their class, and no rule allows."""
    return f"""(SELECT doc_id, s, e, m FROM (SELECT doc_id, s, e, m, i, -sum(n / {_W} * log2(n / {_W})) h
  FROM (SELECT doc_id, s, e, m, i, c, count(*) n FROM (SELECT doc_id, s, e, m, i, substring(m, cast(i + j AS int), 1) c
    FROM (SELECT *, unnest(range(1, length(m) - {_W} + 2)) i FROM {tokens} WHERE NOT ({_ALLOWED})), (SELECT unnest(range(0, {_W})) j)) GROUP BY ALL) GROUP BY ALL)
  GROUP BY doc_id, s, e, m HAVING max(h) >= {_THRESHOLD})"""


OP4 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, 0 off, coalesce(text, '') t FROM documents),
base AS MATERIALIZED (SELECT * FROM {_located("assign", 0, secrets.ASSIGN, f"length(regexp_extract(m, '{_quoted(secrets.ASSIGN)}', 1)) >= 6")}
  UNION ALL {_located("access", 1, secrets.ACCESS)} UNION ALL {_located("hex", 2, secrets.HEX)}),
reach AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM base),
island AS (SELECT doc_id, s, e, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) n FROM reach),
gone AS (SELECT doc_id, min(s) s, max(e) e FROM island GROUP BY doc_id, n),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) p FROM gone),
blank AS (SELECT doc_id, string_agg(substring(t, cast(p + 1 AS int), cast(s - p AS int)) || repeat(' ', cast(e - s AS int)), '' ORDER BY s) || substring(any_value(t), cast(max(e) + 1 AS int)) t FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
left_over AS MATERIALIZED (SELECT doc_id, 0 off, coalesce(b.t, d.t) t FROM d LEFT JOIN blank b USING (doc_id)),
cand AS MATERIALIZED (SELECT * FROM {_located("entropy", 3, secrets.CANDIDATE, texts="left_over")}),
whole AS MATERIALIZED (SELECT * FROM {_hot("cand")}),
rest AS MATERIALIZED (SELECT doc_id, s off, m t FROM cand WHERE regexp_matches(m, '[/_-]') AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.doc_id = cand.doc_id AND w.s = cand.s)),
part AS MATERIALIZED (SELECT * FROM {_located("entropy", 3, secrets.PART, texts="rest")}),
every AS (SELECT doc_id, o, kind, s, e FROM base UNION ALL SELECT doc_id, 3, 'entropy', s, e FROM whole UNION ALL SELECT doc_id, 3, 'entropy', s, e FROM {_hot("part")}),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) j FROM base GROUP BY 1),
x AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(j, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {_WORDS} ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM again) GROUP BY 1),
m AS (SELECT doc_id, cast(len(ws) AS bigint) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] ls, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) n_upper FROM d),
s AS (SELECT m.*, cast(len(ls) AS bigint) n_lines, cast(len(ls) - len(list_distinct(ls)) AS bigint) n_dup_lines, coalesce(rep.n, 0) n_repeat_words FROM m LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END)::BIGINT failure_bits FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 base_failed, failure_bits & 31 = 0 kept, n_lines, n_upper, failure_bits, 'v2' AS policy FROM f
"""

OP8 = f"""
WITH b AS (SELECT item_id, {_WORDS} ws FROM benchmark), d AS (SELECT doc_id, {_WORDS} ws FROM documents),
bg AS MATERIALIZED (SELECT DISTINCT item_id, least(5, len(ws)) n, unnest([array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') for i in range(1, len(ws) - least(5, len(ws)) + 2)]) gram FROM b WHERE len(ws) > 0),
dg AS (SELECT DISTINCT doc_id, n, unnest([array_to_string(ws[i:i + n - 1], ' ') for i in range(1, len(ws) - n + 2)]) gram FROM d, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n),
total AS (SELECT item_id, count(*) n_item_ngrams FROM bg GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) n_found FROM dg JOIN bg USING (n, gram) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item_ngrams, n_found, n_found / n_item_ngrams containment FROM hit JOIN total USING (item_id) WHERE 5 * n_found >= 4 * n_item_ngrams
"""

OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 2 * length(regexp_replace(role, '([<>\[\]|\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<>\[\]|\\])', '\1\\', 'g')) + 9 n FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
 cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
 cast(sum(n) AS bigint) formatted_chars, 0::BIGINT n_attachments, 0::BIGINT attachment_tokens FROM e GROUP BY 1
"""

# crc32 of the decimal id: each character is mixed in, then eight shifts follow
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: [ascii(x)::UBIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: CASE WHEN e > 0 THEN xor(c, e - 1) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END))"""

OP11 = f"""
WITH w AS (SELECT row_number() OVER () r, doc_id, {_WORDS} ws, {_CRC} h FROM documents),
g AS (SELECT *, cast(len(ws) AS bigint) n, cast(h // 10 AS bigint) g FROM w),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END a, 3 + g % 8 b FROM g),
p AS (SELECT r, doc_id, n, a, 1 + (n - a) // b p, ws FROM a),
x AS MATERIALIZED (SELECT r, n, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END word FROM (SELECT *, unnest(range(0, n)) i FROM p)),
same AS (SELECT x.r, x.i, y.i - x.i q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
held AS (SELECT r, q, min(i) s, count(*) + q len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) k FROM same) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM held o WHERE NOT EXISTS (SELECT 1 FROM held i WHERE i.r = o.r AND i.q < o.q AND i.s <= o.s AND i.s + i.len >= o.s + o.len)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) i FROM run),
best AS (SELECT r, count(*) n_runs, arg_max({{'s': s, 'len': len, 'q': q}}, {{'len': len, 's': -s, 'q': -q}}) b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) listed FROM run GROUP BY r),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) t FROM x LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) n_runs, b.s AS "start", b.len AS "length", b.q AS period, 1000 * b.len // b.q exponent_milli, sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
FROM w LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {_TERMS} ts FROM documents),
tf AS MATERIALIZED (SELECT r, t, count(*) tf FROM (SELECT r, unnest(ts) t FROM d) GROUP BY ALL),
n AS (SELECT count(*) big_n, coalesce(sum(len(ts)), 0)::BIGINT big_l FROM d WHERE len(ts) > 0),
w AS (SELECT t, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS bigint) w FROM (SELECT t, count(*) df FROM tf GROUP BY t), n),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * big_n) // big_l m FROM d, n WHERE len(ts) > 0),
item AS (SELECT k, item_id, unnest(list_distinct(ts)) t FROM (SELECT row_number() OVER () k, item_id, {_TERMS} ts FROM benchmark)),
s AS (SELECT k, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT score FROM item JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS "rank" FROM s WHERE score > 0)
SELECT item_id, cast("rank" AS int) AS "rank", doc_id, score FROM ranked WHERE "rank" <= 50
"""

ORACLES = {
    "op1_ngram_join": OP1,
    "op2_url_filters": OP2,
    "op3_warc": OP3,
    "op4_secret_scans": OP4,
    "op7_quality_rules": OP7,
    "op8_decontamination": OP8,
    "op10_chat_formatting": OP10,
    "op11_periodic_runs": OP11,
    "op12_lexical_search": OP12,
}
