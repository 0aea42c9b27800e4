"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from promolift.llm.url_rules import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH payloads AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS page_id FROM payloads WHERE bytes >= 100 GROUP BY digest
)
SELECT p.page_id, CAST(p.bytes AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.page_id <> p.page_id THEN f.page_id END AS refers_to
FROM payloads p LEFT JOIN firsts f ON f.digest = p.digest AND p.bytes >= 100
"""

EXACT = """
WITH digests AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""

# Hit words are those inside an occurrence: a word is hit if a window starts at most its length before it.
CONTAMINATION = f"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, w[i:least(i + 9, len(w))] AS words, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), sizes AS (
  SELECT DISTINCT size FROM windows
), starts AS (
  SELECT r, i, w[i:i + size - 1] AS words, size
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc_words, sizes WHERE len(w) >= size)
), found AS MATERIALIZED (
  SELECT r, i, s.size, item_id FROM starts s JOIN windows n ON s.words = n.words AND s.size = n.size
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS place FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def near_copies(documents: str) -> str:
    """Common table expressions up to ``near``: doc_id, n_shingles and component_id of each row of ``documents``."""
    text = _LOWER.format("coalesce(text, '')")
    return f"""
words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sizes
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), near AS MATERIALIZED (
  SELECT d.doc_id, coalesce(max(sizes.n), 0) AS n_shingles, coalesce(min(reach.root), d.doc_id) AS component_id
  FROM {documents} d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.node = d.doc_id
  GROUP BY d.doc_id
)"""


def _conversations() -> str:
    """Digests of the turns and targets as they were put in; only the formatted length depends on the template.

    A turn's form is ``<s>[INST] role [/INST]text</s>``, which adds 22 characters, and one for each control string.
    Spans are as wide as the budget leaves room beside system turn and history; a turn across a border has its own.
    """
    control = "(s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)"
    escapes = f"len(regexp_extract_all({{0}}, '[<\\[]\\\\*{control}'))"
    cost = "ceil(strlen(text) / 4) + 4"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, {cost} AS cost, row_number() OVER o AS place, coalesce(sum({cost}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts,
         length(role) + length(text) + 22 + {escapes.format("role")} + {escapes.format("text")} AS chars
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), widths AS (
  SELECT conv_id, greatest(1, 512 - 128 - max(CASE WHEN place = 1 AND role = 'system' THEN cost ELSE 0 END)) AS width,
         max(CASE WHEN place = 1 AND role = 'system' THEN cost ELSE 0 END) AS system_cost
  FROM placed GROUP BY conv_id
), spans AS (
  SELECT p.*, system_cost, 2 * CAST(floor(starts / width) AS BIGINT) + CAST(floor((starts + cost - 1) / width) > floor(starts / width) AS BIGINT) AS span
  FROM placed p JOIN widths w ON w.conv_id IS NOT DISTINCT FROM p.conv_id
), heads AS (
  SELECT conv_id, span, min(starts) AS begins, least(128, greatest(0, 512 - max(system_cost) - sum(cost))) AS history FROM spans GROUP BY conv_id, span
), repeats AS (
  SELECT s.conv_id, sum(s.chars) AS chars FROM spans s JOIN heads h ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.span > s.span
  WHERE s.starts >= h.begins - h.history OR (s.place = 1 AND s.role = 'system') GROUP BY s.conv_id
)
SELECT spans.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(spans.chars) + coalesce(max(repeats.chars), 0) AS BIGINT) AS formatted_chars
FROM spans LEFT JOIN repeats ON repeats.conv_id IS NOT DISTINCT FROM spans.conv_id GROUP BY spans.conv_id
"""


def _url_rules() -> str:
    """Verdicts by rule; pages without canonical or refresh links have no aliases, so the rest is allowed."""
    ranked = sorted(RULES, key=lambda rule: -len(rule.host + rule.path))
    fits = [
        (f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')", rule)
        for rule in ranked
    ]
    rule = " ".join(f"WHEN {test} THEN '{one.host}{one.path}'" for test, one in fits)
    verdict = " ".join(f"WHEN {test} THEN '{one.verdict}'" for test, one in fits)
    host = _LOWER.format("regexp_extract(rest, '^[^/?#]*')")
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_prepend(xor(crc, octet), [0, 0, 0, 0, 0, 0, 0, 0])"
    shifted = f"list_reduce({bits}, lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda crc, octet: {shifted}), 4294967295)"


# States: what the role before was; 1 none, 2 system, 3 user, 4 assistant. ``costs`` runs backwards, ``edits`` forwards.
REPAIR = f"""
WITH RECURSIVE base AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
  FROM conversations
), damaged AS (
  SELECT conv, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(generate_series(1, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE harm <> 0
), placed AS (
  SELECT conv, turn, role, text, role[1:1] AS initial, row_number() OVER o AS i,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS times,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
  FROM damaged WINDOW o AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)
), faulty AS MATERIALIZED (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM placed
), ends AS MATERIALIZED (
  SELECT conv, max(i) AS n FROM faulty GROUP BY conv
), moves AS MATERIALIZED (
  SELECT conv, i, role, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS stays,
         CASE initial WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS keeps
  FROM faulty
), costs AS (
  SELECT conv, n + 1 AS i, [0, 4, 2, 0] AS c FROM ends
  UNION ALL
  SELECT conv, i, [least(b[1], 2 + least(b[3], 2 + b[4])), least(b[2], 2 + least(b[3], 2 + b[4])), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
  FROM (
    SELECT m.conv, m.i, list_transform([1, 2, 3, 4], lambda q: least(3 + c[q],
             CASE WHEN must OR keeps[q] = 0 THEN 1000000000 ELSE stays + c[keeps[q]] END,
             CASE WHEN must THEN 1000000000 ELSE 2 + stays + c[[3, 3, 4, 3][q]] END)) AS b
    FROM costs JOIN moves m ON m.conv = costs.conv AND m.i = costs.i - 1
  )
), tables AS MATERIALIZED (
  SELECT x.conv, x.i, x.c, y.c AS d, m.role, m.text, m.must, m.stays, m.keeps
  FROM costs x LEFT JOIN costs y ON y.conv = x.conv AND y.i = x.i + 1 LEFT JOIN moves m ON m.conv = x.conv AND m.i = x.i
), edits AS (
  SELECT conv, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS finished FROM ends
  UNION ALL
  SELECT conv, CASE edit WHEN 'I' THEN i WHEN '' THEN i ELSE i + 1 END,
         CASE edit WHEN 'K' THEN keeps[q] WHEN 'D' THEN q WHEN '' THEN q ELSE [3, 3, 4, 3][q] END, audit || edit,
         CASE edit WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'I' THEN list_append(lines, ['user:', 'user:', 'assistant:', 'user:'][q])
                   WHEN 'R' THEN list_append(lines, ['user:', 'user:', 'assistant:', 'user:'][q] || text) ELSE lines END, edit = ''
  FROM (
    SELECT e.*, t.role, t.text, t.keeps, CASE
             WHEN d IS NULL AND c[q] = 0 THEN ''
             WHEN d IS NOT NULL AND 3 + d[q] = c[q] THEN 'D'
             WHEN 2 + c[[3, 3, 4, 3][q]] = c[q] THEN 'I'
             WHEN NOT must AND keeps[q] > 0 AND stays + d[keeps[q]] = c[q] THEN 'K'
             ELSE 'R' END AS edit
    FROM edits e JOIN tables t ON t.conv = e.conv AND t.i = e.i WHERE NOT finished
  )
), summary AS (
  SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM base) b LEFT JOIN summary USING (conv) LEFT JOIN (SELECT conv, c FROM costs WHERE i = 1) first USING (conv)
LEFT JOIN (SELECT conv, audit, lines FROM edits WHERE finished) USING (conv)
"""

DIVERGENCE = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), words AS MATERIALIZED (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS MATERIALIZED (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM (SELECT DISTINCT lang, source FROM docs) g
  JOIN kept k ON k.lang = g.lang LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), ps AS MATERIALIZED (
  SELECT lang, source, term, c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p
  FROM cells JOIN sizes USING (lang)
), qs AS MATERIALIZED (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM cells GROUP BY lang, term) JOIN sizes USING (lang)
), sums AS (
  SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
  FROM ps x JOIN ps y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM ps JOIN qs USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def all_oracles() -> dict[str, str]:
    return {
        "op2_warc": WARC,
        "op3_chat": _conversations(),
        "op6_exact_dedup": EXACT,
        "op7_decontaminate": CONTAMINATION,
        "op8_url_rules": _url_rules(),
        "op9_ngram_jaccard": f"WITH RECURSIVE {near_copies('documents')} SELECT * FROM near",
        "op11_repair": REPAIR,
        "op12_divergence": DIVERGENCE,
    }
