"""DuckDB SQL for the queries that SQL can express.

The others (token files, packing, 64-bit SimHash, learnt scores, eigenvectors) are held against brute force in
the tests.
"""

from .decontam import BAND, LITERALS, SHARE, UNITS, WINDOW, WORDS
from .licences import AGREE, BASE, STOP, TEMPLATES, key_places, notice_places
from .pii import _OCTET, CONTEXT, CONTEXT_BONUS, IBAN_SIZES, KINDS

_PROBE = "<|im_end|><|im_start|>assistant ok"

OP1 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN strlen(html) >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM f"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(d.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN degree d ON d.a = r.a GROUP BY r.a"""

_NEEDED = "least({0}, greatest(" + str(WORDS) + ", ceil({0} * " + str(SHARE) + ")))"
_RAW = r"list_filter(string_split_regex(translate(coalesce(text, ''), chr(304) || chr(1) || chr(2) || chr(3), 'I   '), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
OP9 = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, {_RAW} AS r FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'i', item_id, {_RAW} FROM benchmark WHERE item_id IS NOT NULL),
marked AS (SELECT *, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN kind = 2 THEN '' WHEN regexp_matches(r[i], '^[0-9]') THEN chr(2) WHEN i > 1 AND regexp_matches(r[i - 1], '^[0-9]') AND lower(r[i]) IN ({', '.join(repr(u) for u in UNITS)}) THEN chr(3) WHEN kind = 0 AND regexp_matches(r[i], '^[\p{{Lu}}\p{{Lt}}]') THEN chr(1) ELSE '' END) AS m FROM src, (VALUES (0), (1), (2)) k(kind) WHERE len(r) > 0),
started AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: m[i] IN ('', chr(3)) OR i = 1 OR m[i - 1] <> m[i]) AS s FROM marked),
tpl AS (SELECT side, id, kind, len(r) AS n_raw, len(s) AS n, list_transform(s, lambda i: CASE WHEN m[i] <> '' THEN m[i] ELSE lower(r[i]) END) AS t,
  list_transform(range(1, len(s) + 1), lambda k: array_to_string(r[s[k]:coalesce(s[k + 1], len(r) + 1) - 1], ' ')) AS v, list_transform(range(1, len(s) + 1), lambda k: coalesce(s[k + 1], len(r) + 1) - s[k]) AS width FROM started),
it AS (SELECT *, least(n, {WINDOW}) AS size FROM tpl WHERE side = 'i'),
bw0 AS (SELECT kind, id AS item_id, size, p, t[p + 1:p + size] AS win FROM (SELECT *, unnest(range(0, n - size + 1)) AS p FROM it)),
bw AS (SELECT kind, item_id, size, p, array_to_string(win, ' ') AS k FROM bw0 WHERE CASE WHEN kind = 2 THEN len(list_filter(win, lambda w: NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({', '.join(repr(u) for u in UNITS)}))) < {LITERALS}
  ELSE len(list_filter(win, lambda w: w NOT IN (chr(1), chr(2), chr(3)))) >= {LITERALS} AND (kind = 1 OR list_contains(win, chr(1))) END),
dw AS (SELECT kind, id AS doc_id, size, p, array_to_string(t[p + 1:p + size], ' ') AS k FROM (SELECT *, unnest(range(0, n - size + 1)) AS p FROM tpl JOIN (SELECT DISTINCT kind, size FROM bw) USING (kind) WHERE side = 'd' AND n >= size)),
runs AS (SELECT kind, doc_id, item_id, dw.p - bw.p AS shift, count(DISTINCT bw.p) AS m, min(bw.p) AS lo FROM dw JOIN bw USING (kind, k, size) GROUP BY ALL),
anchors AS (SELECT kind, doc_id, item_id, shift FROM (SELECT *, row_number() OVER (PARTITION BY kind, doc_id, item_id, floor(shift / {BAND}.0) ORDER BY m DESC, lo DESC, shift DESC) AS nth FROM runs) WHERE nth = 1),
each_word AS (SELECT a.*, unnest(range(0, it.n)) AS p FROM anchors a JOIN it ON it.kind = a.kind AND it.id = a.item_id),
near AS (SELECT *, unnest(range(p + shift - {BAND}, p + shift + {BAND} + 1)) AS q FROM each_word),
agreed AS (SELECT near.kind, doc_id, item_id, shift, p, it.n_raw AS n_item, it.n, it.t[p + 1] IN (chr(1), chr(2), chr(3)) AS slot, it.v[p + 1] AS i, dt.v[q + 1] AS d, it.width[p + 1] AS width, p > 0 AND p < it.n - 1 AS inside,
  row_number() OVER (PARTITION BY near.kind, doc_id, item_id, shift, p ORDER BY abs(q - p - shift), q) AS nth
  FROM near JOIN it ON it.kind = near.kind AND it.id = item_id JOIN tpl dt ON dt.side = 'd' AND dt.kind = near.kind AND dt.id = doc_id WHERE q >= 0 AND it.t[p + 1] = dt.t[q + 1] AND (it.n = 1 OR (p > 0 AND q > 0 AND it.t[p] = dt.t[q]) OR it.t[p + 2] = dt.t[q + 2])),
met AS (SELECT kind, doc_id, item_id, shift, n_item, n, count(*) AS n_pairs, sum(CASE WHEN slot AND i = d THEN width ELSE 1 END) AS matched, coalesce(sum(width) FILTER (slot AND inside), 0) AS n_slots, coalesce(sum(width) FILTER (slot AND inside AND i <> d), 0) AS n_changed,
  count(DISTINCT i) FILTER (slot AND inside) = count(DISTINCT i || chr(0) || d) FILTER (slot AND inside) AS consistent FROM agreed WHERE nth = 1 GROUP BY ALL),
good AS (SELECT * FROM met WHERE (matched >= {_NEEDED.format("n_item")} OR n_pairs >= {_NEEDED.format("n")}) AND (consistent OR n_changed * 10 <= n_slots))
SELECT doc_id, item_id, matched::BIGINT AS matched_words, n_item::BIGINT AS item_words, n_slots::BIGINT AS n_slots, n_changed::BIGINT AS n_changed, consistent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, kind DESC, n_changed, shift) AS nth FROM good) WHERE nth = 1"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


_NOTICES = [(t, label, p, w) for t, (label, _, _) in enumerate(TEMPLATES) for p, w in notice_places(t)]
_KEYS = [(t, p, w, w in STOP) for t in range(len(TEMPLATES)) for p, w in key_places(t)]
_PHRASES = [(label, p.split()) for p, label in BASE.items()]
OP10 = rf"""
WITH notice(template, label, place, word) AS (VALUES {_values(_NOTICES)}), key(template, place, word, common) AS (VALUES {_values(_KEYS)}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
base AS ({" UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, k FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS k FROM d WHERE list_contains(ws, '{p[0]}')) WHERE ws[k + 1:k + {len(p)}] = {p}" for label, p in _PHRASES)}),
bases AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY doc_id),
hit AS (SELECT doc_id, pos, ws[pos + 1] AS word FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS pos FROM d) WHERE ws[pos + 1] IN (SELECT word FROM notice)),
enough AS (SELECT doc_id FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos, ws FROM d) WHERE list_contains([{", ".join(repr(w) for w in sorted({w for _, _, _, w in _NOTICES} | {w for _, _, w, _ in _KEYS}))}], ws[pos + 1]) GROUP BY doc_id HAVING count(*) >= 2),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM hit JOIN enough USING (doc_id) GROUP BY word),
lookup AS (SELECT template, place, word FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), place) AS r FROM key LEFT JOIN df USING (word) WHERE NOT common) WHERE r <= {AGREE}),
near AS (SELECT doc_id, template, pos - place AS shift FROM hit JOIN lookup USING (word) GROUP BY ALL HAVING count(DISTINCT place) >= {AGREE}),
sure AS (SELECT n.doc_id, n.template, n.shift FROM near n JOIN d USING (doc_id) JOIN key k USING (template) GROUP BY ALL HAVING bool_and(coalesce(ws[k.place + n.shift + 1] = k.word, false) AND k.place + n.shift >= 0)),
shares AS (SELECT s.doc_id, x.label, s.shift, count(*) FILTER (x.place + s.shift >= 0 AND ws[x.place + s.shift + 1] = x.word) / count(*) AS share FROM sure s JOIN d USING (doc_id) JOIN notice x USING (template) GROUP BY s.doc_id, x.label, s.shift, s.template),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM shares GROUP BY doc_id),
own AS (SELECT doc_id, list(DISTINCT label) AS labels FROM base GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.labels, []::VARCHAR[]), coalesce(m.labels, []::VARCHAR[])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.score, 0) END::DOUBLE AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN method m USING (doc_id) LEFT JOIN own o USING (doc_id)"""

_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP8 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(rf"found{no} AS (SELECT rid, {no} AS no, '{k}' AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM t)" for no, (k, p) in enumerate(_PATTERNS.items()))},
each AS (SELECT rid, no, kind, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k FROM (SELECT * FROM found0 UNION ALL SELECT * FROM found1 UNION ALL SELECT * FROM found2 UNION ALL SELECT * FROM found3) WHERE len(ms) > 0),
placed AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY rid, no ORDER BY k) - length(m))::BIGINT AS s, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM each),
base AS (SELECT rid, no, kind, s, s + length(m) AS e FROM placed WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN regexp_matches(m, '^{_OCTET}(?:\.{_OCTET}){{3}}$')
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN substr(digits, i, 1)::INT ELSE 2 * substr(digits, i, 1)::INT // 10 + 2 * substr(digits, i, 1)::INT % 10 END)) % 10 = 0 END),
spot AS (SELECT rid, text, unnest(range(1, length(text) - 13)) AS i FROM t WHERE regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}}')),
head AS (SELECT rid, i - 1 AS s, substr(text, i, 68) AS tail FROM spot WHERE regexp_matches(substr(text, i, 68), '^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11}}') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9]'))),
ends AS (SELECT rid, s, unnest([{", ".join(rf"regexp_extract(tail, '^([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}})(?:[^A-Za-z0-9]|$)', 1)" for n in range(11, 31))}]) AS x FROM head),
valid AS (SELECT rid, s, x, replace(x, ' ', '') AS y FROM ends WHERE x <> '' AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(x, ' ', ''), 5) || left(replace(x, ' ', ''), 4), ''), lambda c: instr('{_LETTERS}', c) - 1)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1),
sized AS (SELECT v.*, coalesce(length(y) = n, false) AS fits FROM valid v LEFT JOIN (VALUES {", ".join(f"('{c}', {n})" for n, codes in IBAN_SIZES.items() for c in codes.split())}) z(code, n) ON code = left(y, 2)),
best AS (SELECT rid, s, s + length(x) AS e FROM (SELECT *, row_number() OVER (PARTITION BY rid, s ORDER BY fits DESC, length(x) DESC) AS nth FROM sized) WHERE nth = 1),
iban AS (SELECT rid, 4 AS no, 'iban' AS kind, s, e FROM (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) WHERE s >= coalesce(before, 0)),
hint(kind, score, p) AS (VALUES {", ".join(rf"('{k}', {score}, '(^|[^\p{{L}}\p{{N}}_])(?:{hints})')" for k, (_, _, hints, score) in KINDS.items())}),
spans AS (SELECT x.*, h.score + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0)) || ' ' || substr(text, e + 1, {CONTEXT})), h.p) THEN {CONTEXT_BONUS} ELSE 0 END AS total FROM (SELECT * FROM base UNION ALL SELECT * FROM iban) x JOIN t USING (rid) JOIN hint h USING (kind)),
joined AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 4) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans, string_agg(printf('%.2f', total), ',' ORDER BY s, no) AS scores FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN joined USING (rid)"""

_WHOLE = "SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
OP11 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM ({_WHOLE}) WHERE label IS NOT NULL),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM met WHERE same) WHERE nth <= 5),
neg AS (SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM pos p JOIN met n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
OP13 = f"""
WITH v AS ({_WHOLE}), met AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.x, p.x)::BIGINT AS score FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.x) = len(p.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM met) WHERE rank <= 5"""

SQL: dict[str, str] = {
    "op1_chat_prefix_targets": OP1,
    "op5_warc_seekable_zstd": OP5,
    "op6_collision_projections": OP6,
    "op8_pii_checksums": OP8,
    "op9_template_decontamination": OP9,
    "op10_licence_positions": OP10,
    "op11_inverted_multi_index": OP11,
    "op13_segment_top_k": OP13,
}
