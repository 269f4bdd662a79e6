"""DuckDB SQL for the queries of quern.plans.registry that SQL can express."""

from __future__ import annotations

from quern.config import STOPWORDS, hybrid_stopwords
from quern.functions.text import FOOTER_PHRASES
from quern.functions.urls import ASSET_ENDINGS, DENIED_PHRASES, DOCUMENT_ENDINGS, LOGIN_HOSTS, LOGIN_PATHS_ON_SITE, SIGN_IN_TITLES
from quern.operators.answer import INSUFFICIENT, NO_PASSAGES

_HOSTS = ("example.com", "example.org", "www.example.com")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(text: str, phrases) -> str:
    return f"list_bool_or(list_transform({_list(phrases)}, lambda p: contains({text}, p)))"


def _terms(text: str, stop=STOPWORDS) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9-]{{2,}}'), lambda x: NOT list_contains({_list(stop)}, x))"
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {kept} AS l))"


_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_SPACE}+|{_SPACE}+\z', '', 'g')"


def _normal(c: str) -> str:
    return f"lower(regexp_replace({_strip(f'coalesce({c}, chr(32))')}, '{_SPACE}+', ' ', 'g'))"


def _slug(c: str, fallback: str) -> str:
    base = rf"regexp_replace(regexp_replace(lower({_strip(c)}), '[^a-zA-Z0-9._-]+', '-', 'g'), '\A-+|-+\z', '', 'g')"
    return f"coalesce(nullif({base}[1:80], ''), '{fallback}')"


_ABS = r"(?i)\A(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def _part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{_ABS}', {k})"


_AUTH = rf"regexp_replace({_part('url', 2)}, '\A.*@', '')"
_HOST = rf"lower(regexp_extract({_AUTH}, '\A([^:]*)', 1))"
_PATH = _part("url", 3)
_PORT = rf"regexp_extract({_AUTH}, ':(\d+)\z', 1)"


def _ends(endings) -> str:
    return f"list_bool_or(list_transform({_list(endings)}, lambda e: suffix(lower({_PATH}), e)))"


_NORMAL_URL = rf"""CASE WHEN regexp_matches(url, '{_ABS}') AND {_part('url', 2)} <> '' THEN
  lower({_part('url', 1)}) || '://' || {_HOST} || CASE WHEN {_PORT} IN ('', '80', '443') THEN '' ELSE ':' || {_PORT} END
  || regexp_replace(coalesce(nullif(regexp_replace({_PATH}, ';[^/]*\z', ''), ''), '/'), '/+', '/', 'g')
  || CASE WHEN {_part('url', 4)} <> '' THEN '?' || {_part('url', 4)} ELSE '' END END"""

_IN_HOSTS = f"{_HOST} IN ({', '.join(repr(h) for h in _HOSTS)})"

_CORPUS = """
corpus AS (SELECT d.doc_id::VARCHAR AS chunk_id, d.text, d.source AS title, 'https://hub.example.com/' || d.doc_id AS url, d.lang AS section,
  CASE WHEN l.toxic = 1 THEN 'restricted' ELSE 'authenticated' END AS access, d.doc_id AS pos, e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l USING (doc_id)),
questions AS (SELECT c.conv_id AS query_id, c.question, e.embedding::DOUBLE[] AS vector FROM
  (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id) c LEFT JOIN embeddings e ON c.conv_id = e.vec_id)
"""

_VECTOR = """
vec_all AS (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(vector, embedding), 6) AS distance FROM questions, corpus WHERE vector IS NOT NULL AND embedding IS NOT NULL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vec_all QUALIFY rank <= 12)
"""

_KEYWORD = f"""
asked AS (SELECT query_id, question, {_terms('question')} AS terms FROM questions),
first_terms AS (SELECT query_id, unnest(terms[1:4]) AS term, unnest(range(least(4, len(terms)))) AS term_no FROM asked),
found AS (SELECT term, chunk_id, pos, row_number() OVER (PARTITION BY term ORDER BY pos, chunk_id) AS nth
  FROM (SELECT DISTINCT term FROM first_terms), corpus WHERE contains(text, term) QUALIFY nth <= 12),
hits AS (SELECT query_id, chunk_id, min((term_no, nth)) AS first_pos FROM first_terms JOIN found USING (term) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, first_pos, least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * len(list_filter(terms, lambda t: contains(lower(title || ' ' || text), t)))) AS base,
  title <> '' AND contains(lower(question), lower(title)) AS named FROM hits JOIN asked USING (query_id) JOIN corpus USING (chunk_id)),
kw_all AS (SELECT query_id, chunk_id, first_pos, round(CASE WHEN named THEN least(1.0::DOUBLE, base + 0.2::DOUBLE) ELSE base END, 6) AS relevance FROM scored),
kw AS (SELECT query_id, chunk_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, first_pos) AS rank FROM kw_all QUALIFY rank <= 12)
"""

_FUSED = """
both_lists AS (SELECT query_id, 0 AS list_no, chunk_id, rank, greatest(0, least(1, 1 - distance)) AS relevance FROM vec UNION ALL SELECT query_id, 1, chunk_id, rank, relevance FROM kw),
rrf AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(relevance) AS best, min((list_no, rank)) AS seen FROM both_lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, least(1.0, greatest(best, score)) AS relevance, best, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS position FROM rrf)
"""

_HYBRID = """
rated AS (SELECT f.query_id, f.chunk_id, f.position, round(CASE WHEN k.query_id IS NULL THEN f.best ELSE f.relevance END, 6) AS relevance
  FROM fused f LEFT JOIN (SELECT DISTINCT query_id FROM kw) k USING (query_id)),
hybrid AS (SELECT r.query_id, r.chunk_id, r.relevance, c.title, c.url, c.section, c.text, row_number() OVER (PARTITION BY r.query_id
  ORDER BY (c.title <> '' AND contains(lower(q.question), lower(c.title))) DESC, r.relevance DESC, r.position) AS rank
  FROM rated r JOIN corpus c USING (chunk_id) JOIN questions q USING (query_id) WHERE c.access IN ('authenticated', 'authorized') QUALIFY rank <= 5)
"""

_ALL = f"WITH {_CORPUS}, {_VECTOR}, {_KEYWORD}, {_FUSED}, {_HYBRID}"

_BLOCKS = """
blocks AS (SELECT query_id, rank, '[Source ' || rank || '] title=' || title || chr(10) || 'url=' || url || chr(10) || 'section=' || section || chr(10)
  || 'relevance=' || format('{:.3f}', relevance) || chr(10) || 'content:' || chr(10) || text AS block FROM hybrid),
budget AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS chars FROM blocks QUALIFY rank = 1 OR chars <= 12000)
"""

_PAIRS = """
pairs AS (SELECT conv_id, turn, role, coalesce(text, '') AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN coalesce(lead(text) OVER w, '') ELSE '' END AS answer
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, question, answer FROM pairs WHERE role = 'user')
"""

_LINES = """
line_rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT *, CASE WHEN pos % 10 = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM line_rows)
"""

_RECORDS = f"""
records AS (SELECT doc_id::VARCHAR AS id, text, 'https://hub.example.com/' || (doc_id // 5) AS url, sha256({_normal('text')}) AS content_hash, doc_id AS pos FROM documents),
edited AS (SELECT doc_id::VARCHAR AS id, 'https://hub.example.com/' || (doc_id // 5) AS url,
  sha256({_normal("CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END")}) AS content_hash FROM documents),
before AS (SELECT * FROM records WHERE pos % 2 = 0),
stale AS (SELECT b.id, b.url FROM before b WHERE b.url IN (SELECT url FROM edited) AND NOT EXISTS (SELECT 1 FROM edited e WHERE e.url = b.url AND e.content_hash = b.content_hash)),
held AS (SELECT * FROM before WHERE id NOT IN (SELECT id FROM stale)),
fresh AS (SELECT * FROM edited WHERE id NOT IN (SELECT id FROM held)),
after AS (SELECT id, url, content_hash FROM held UNION ALL SELECT id, url, content_hash FROM fresh)
"""

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_MOVED = r"moved AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN regexp_replace(url, '\Ahttps?://[^/?#]*', 'https://hub.example.com') ELSE url END AS url, html FROM pages)"
_STATE = rf"""{_MOVED},
last_page AS (SELECT url, max(page_id) AS pos, arg_max(html, page_id) AS html FROM moved GROUP BY url),
state AS (SELECT pos, url, {_TITLE} AS title, CASE WHEN pos % 2 = 0 THEN sha256({_normal('html')}) ELSE '0' END AS content_hash,
  CASE WHEN pos % 5 = 0 THEN 'FAILED' WHEN pos % 5 = 1 THEN 'PENDING' ELSE 'PROCESSED' END AS status FROM last_page),
hay AS (SELECT nurl AS url, title || ' ' || nurl || ' ' || url || '/a.pdf' AS haystack FROM (SELECT *, {_NORMAL_URL} AS nurl FROM state WHERE {_HOST} = 'hub.example.com'))
"""
_KNOWN_STATE = _STATE.replace("FROM moved GROUP BY", "FROM moved WHERE page_id % 3 <> 0 GROUP BY")
_RANKED = f"""asked_q AS (SELECT query_id, {_terms('question')} AS terms FROM (SELECT conv_id AS query_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)),
match AS (SELECT query_id, url, len(list_filter(terms, lambda t: contains(lower(haystack), t)))::INT AS score FROM asked_q, hay),
ranked AS (SELECT query_id, url, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM match WHERE score > 0 QUALIFY rank <= 10)
"""
_DECIDED = rf"""{_MOVED},
variants AS (SELECT page_id, unnest([url, regexp_replace(url, '\Ahttps:', 'http:'), split_part(url, '?', 1) || '/a.pdf', split_part(url, '?', 1) || '/b.PNG', 'mailto:x', url]) AS url, unnest(range(6)) AS k FROM moved),
norm AS (SELECT page_id * 10 + k AS pos, {_NORMAL_URL} AS url, (page_id % 10)::INT AS depth FROM variants),
ruled AS (SELECT *, CASE WHEN url IS NULL THEN 'invalid' WHEN {_HOST} <> 'hub.example.com' THEN 'external' WHEN NOT prefix(url, 'https:') THEN 'not_approved_https_url' WHEN {_ends(DOCUMENT_ENDINGS)} THEN 'document_link'
  WHEN {_ends(ASSET_ENDINGS)} THEN 'non_html_asset' WHEN depth > 8 THEN 'max_depth_exceeded' ELSE 'candidate' END AS rule FROM norm),
firsts AS (SELECT url, min(pos) AS first_pos FROM ruled WHERE rule = 'candidate' GROUP BY url ORDER BY first_pos LIMIT 60),
decided AS (SELECT pos, url, depth, CASE WHEN rule <> 'candidate' THEN rule WHEN first_pos IS NULL THEN 'max_pages_budget' WHEN pos = first_pos THEN 'queued' ELSE 'duplicate' END AS decision FROM ruled LEFT JOIN firsts USING (url))
"""

_REDACTED = r"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(cookie|set-cookie|authorization|bearer|password|passwd|secret|token|mfa|otp)\s*[=:]\s*\S+', '\1=***', 'g'), '(?i)\bbearer\s+\S+', 'bearer ***', 'g')"
_ERROR = rf"""'ValueError: ' || regexp_replace(regexp_replace(regexp_replace(coalesce(nullif({_strip("coalesce(text, '')")}, ''), 'ValueError'), '(?i)(api[_-]?key|password|secret|token)\s*[=:]\s*\S+', '\1=***', 'g'),
  '(?i)\bbearer\s+\S+', 'bearer ***', 'g'), '\bsk-[A-Za-z0-9_-]{{8,}}', '***', 'g')"""

_FOOTER = f"(len(low) = 0 OR (len(low) < 120 AND {_any('low', FOOTER_PHRASES)}) OR regexp_full_match(low, '(?:©|\\(c\\))[^\\n]*'))"
_RULES = f"Instructions:\n- Ground every statement in the passages.\n- Cite sources by title and URL.\n- If evidence is missing, say so.\n- Otherwise answer: {INSUFFICIENT}\n"


def _plain(c: str) -> str:
    """Character references of the fixture's pages read, white space collapsed; HTML reads these names without a semicolon too."""
    for name, sign in (("quot|QUOT", '"'), ("lt|LT", "<"), ("gt|GT", ">"), ("copy|COPY", "©"), ("middot", "·"), ("amp|AMP", "&")):
        c = f"regexp_replace({c}, '&(?:{name});?', '{sign}', 'g')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_LINKS = rf"""
hrefs AS (SELECT page_id, {_NORMAL_URL} AS base, {_part('url', 1)} || '://' || {_part('url', 2)} AS site, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM source_pages),
anchors AS (SELECT page_id, base, site || replace(unnest(hs), '&amp;', '&') AS url, unnest(ts) AS text, unnest(range(len(hs))) AS k FROM hrefs),
normal_links AS (SELECT page_id, base, k, {_plain('text')} AS text, {_NORMAL_URL} AS url FROM anchors),
first_links AS (SELECT page_id, base, url, min(k) AS k, arg_min(text, k) AS text FROM normal_links GROUP BY ALL),
links AS (SELECT page_id, base, url, text, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS pos FROM first_links)
"""

_PAGES = "source_pages AS (SELECT page_id, url, html FROM pages)"

_H_TITLE = _plain(_TITLE)
_H_PARTS = rf"""
h_parts AS (SELECT page_id, url, {_H_TITLE} AS title, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<p>((?:[^<]|<b>|<br>)*)', 1) AS ps FROM pages),
h_rows AS (SELECT page_id, h1, 0 AS k, 'heading' AS kind, '# ' || h1 AS text FROM h_parts WHERE h1 <> ''
  UNION ALL SELECT page_id, h1, unnest(range(1, len(ps) + 1)), 'paragraph', {_plain("regexp_replace(unnest(ps), '<[^>]*>', ' ', 'g')")} FROM h_parts),
h_kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, lower(text) ORDER BY k) AS nth FROM (SELECT *, lower(text) AS low FROM h_rows) WHERE kind = 'heading' OR NOT {_FOOTER}),
h_blocks AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS pos, kind, text, h1 AS heading, h1 AS section, CASE kind WHEN 'heading' THEN 1 ELSE 0 END::INT AS level
  FROM h_kept WHERE kind = 'heading' OR nth = 1 OR length(text) >= 180),
h_clean AS (SELECT p.page_id, p.url, p.title, p.h1, coalesce(string_agg(b.text, chr(10) || chr(10) ORDER BY b.pos), '') AS cleaned_text FROM h_parts p LEFT JOIN h_blocks b USING (page_id) GROUP BY ALL)
"""

_VISIBLE = rf"""
v_text AS (SELECT page_id, {_H_TITLE} AS title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '<x>', 'g'), '\s+', ' ', 'g'),
  '<!--(.*?)-->', '<x>\1<x>', 'g'), '<!DOCTYPE html>', 'html<x>') AS flat FROM pages),
visible AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split_regex(flat, '<[^>]*>'), lambda x: {_plain('x')}), lambda x: x <> ''), chr(10)) AS visible_text FROM v_text)
"""


def _windows(c: str) -> str:
    """Pieces of 4,000 characters, each 600 before the last one's end."""
    last = f"CASE WHEN length({c}) <= 4000 THEN 0 ELSE (length({c}) - 4000 + 3399) // 3400 END"
    return f"list_transform(range({last} + 1), lambda i: {c}[i * 3400 + 1 : i * 3400 + 4000])"


_JOINED = _strip("held || chr(10) || chr(10) || unit")
_TAILED = _strip("right(held, 600) || chr(10) || chr(10) || unit")
_MERGED = _strip("out[-1] || chr(10) || chr(10) || piece")
#: Pieces of texts (key, heading, section, url, title, hash, text): packed from paragraphs or lines, then tiny ones merged.
_CHUNKED = rf"""
c_units AS (SELECT key, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ps,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM groups WHERE length(text) > 4000),
c_lists AS (SELECT key, CASE WHEN len(ps) > 1 THEN ps ELSE ls END AS units FROM c_units WHERE len(ps) > 1 OR len(ls) > 1),
c_fold AS (SELECT key, units, 0 AS n, ''::VARCHAR AS held, []::VARCHAR[] AS out FROM c_lists
  UNION ALL SELECT key, units, n + 1,
    CASE WHEN length(unit) > 4000 THEN '' WHEN length({_JOINED}) <= 4000 THEN {_JOINED} WHEN length({_TAILED}) > 4000 THEN '' ELSE {_TAILED} END,
    CASE WHEN length(unit) > 4000 THEN out || CASE WHEN held <> '' THEN [held] ELSE [] END || {_windows('unit')} WHEN length({_JOINED}) <= 4000 THEN out
      WHEN length({_TAILED}) > 4000 THEN out || [held] || {_windows(_TAILED)} ELSE out || [held] END
  FROM (SELECT *, units[n + 1] AS unit FROM c_fold WHERE n < len(units))),
c_pieces AS (SELECT key, out || CASE WHEN held <> '' THEN [held] ELSE [] END AS pieces FROM c_fold WHERE n = len(units)
  UNION ALL SELECT key, [text] FROM groups WHERE length(text) <= 4000
  UNION ALL SELECT key, {_windows('text')} FROM c_units WHERE len(ps) < 2 AND len(ls) < 2),
c_merge AS (SELECT key, pieces, 0 AS n, []::VARCHAR[] AS out, []::VARCHAR[] AS starts FROM c_pieces
  UNION ALL SELECT key, pieces, n + 1, CASE WHEN merges THEN out[:-2] || [{_MERGED}] ELSE out || [piece] END, CASE WHEN merges THEN starts ELSE starts || [piece[1:200]] END
  FROM (SELECT *, len(out) > 0 AND (length(piece) + 3) // 4 < 40 AND (length({_MERGED}) + 3) // 4 <= 1150 AS merges FROM (SELECT *, pieces[n + 1] AS piece FROM c_merge WHERE n < len(pieces)))),
c_rows AS (SELECT key, unnest(out) AS text, unnest(starts) AS seed, unnest(range(len(out))) AS chunk_no FROM c_merge WHERE n = len(pieces)),
chunks AS (SELECT g.*, r.text AS chunk, r.chunk_no, coalesce(nullif(g.heading, ''), g.title) AS h, r.seed FROM c_rows r JOIN groups g USING (key)),
chunk_rows AS (SELECT {_slug("coalesce(nullif(h, ''), 'intro')", 'intro')} || '-' || lpad(chunk_no::VARCHAR, greatest(4, length(chunk_no::VARCHAR))::INT, '0') || '-' || sha1(url || '|' || h || '|' || chunk_no || '|' || seed)[1:12] AS chunk_id,
  {_slug("coalesce(nullif(title, ''), url)", 'document')} || '-' || right({_slug('url', 'page')}, 12) AS document_id, url, coalesce(nullif(section, ''), h) AS section, h AS heading,
  ((length(chunk) + 3) // 4)::INT AS token_count, chunk_no::INT AS chunk_no, hash AS content_hash, chunk AS text, title, key FROM chunks)
"""
_PAGE_GROUPS = f"""SELECT 'p' || page_id AS key, h1 AS heading, h1 AS section, url, title, sha256({_normal("title || chr(10) || visible_text")}) AS hash, {_strip('cleaned_text')} AS text FROM h_clean JOIN visible USING (page_id, title) WHERE cleaned_text <> ''"""
_DOC_GROUPS = f"""SELECT 'd' || doc_id AS key, source AS heading, '' AS section, 'https://hub.example.com/' || doc_id AS url, source AS title, sha256({_normal('text')}) AS hash, {_strip('text')} AS text FROM documents WHERE {_strip('text')} <> ''"""

_FIT = f"NOT {_ends([*ASSET_ENDINGS, *DOCUMENT_ENDINGS])} AND prefix(url, 'https:') AND {_HOST} = 'hub.example.com'"
#: Breadth first from all pages: links lead to pages, which are there already, or to URLs without a page.
_FRONTIER = f"""source_pages AS (SELECT page_id, url, html FROM moved), {_LINKS}, site_pages AS (SELECT coalesce({_NORMAL_URL}, url) AS nurl, page_id FROM moved),
ok AS (SELECT * FROM links WHERE {_FIT} AND page_id IN (SELECT min(page_id) FROM site_pages GROUP BY nurl)),
starts AS (SELECT page_id, {_NORMAL_URL} AS url FROM moved), fit_starts AS (SELECT url, min(page_id) AS p FROM starts WHERE {_FIT} GROUP BY url),
zero AS (SELECT url, 0 AS depth, row_number() OVER (ORDER BY p) AS order_no FROM fit_starts),
one AS (SELECT o.url, 1 AS depth, row_number() OVER (ORDER BY min((z.order_no, o.page_id * 100000 + o.pos))) + (SELECT count(*) FROM zero) AS order_no
  FROM ok o JOIN zero z ON o.base = z.url WHERE o.url NOT IN (SELECT url FROM zero) GROUP BY o.url),
visited AS (FROM zero UNION ALL FROM one)
"""
#: What a fetch comes to where its hash is never the known one.
_OUTCOME = f"""CASE WHEN {_any(_HOST, LOGIN_HOSTS)} OR {_HOST} <> 'hub.example.com' OR {_any(f'lower({_PATH})', LOGIN_PATHS_ON_SITE)} THEN 'session_expired' WHEN code IN (401, 403) THEN 'access_denied' WHEN code >= 400 THEN 'http_error'
  WHEN {_any('hay', DENIED_PHRASES)} THEN 'access_denied' WHEN coalesce(old, '') <> '' THEN 'updated' ELSE 'new' END"""
_STATUS = "CASE outcome WHEN 'session_expired' THEN 'PROCESSING' WHEN 'access_denied' THEN 'ACCESS_DENIED' WHEN 'http_error' THEN 'FAILED' WHEN 'updated' THEN 'UPDATED' ELSE 'PROCESSED' END"
_RULE = f"""CASE WHEN url IS NULL THEN 'invalid' WHEN {_HOST} <> 'hub.example.com' THEN 'external' WHEN NOT prefix(url, 'https:') THEN 'not_approved_https_url'
  WHEN {_ends(DOCUMENT_ENDINGS)} THEN 'document_link' WHEN {_ends(ASSET_ENDINGS)} THEN 'non_html_asset' ELSE 'candidate' END"""


def _sequential(seeds: str, budget: int, code: str, renewals: str) -> str:
    """A crawl as it goes one page at a time: each step takes the queue's first page and queues its links while there is room."""
    followed = "outcome IN ('new', 'updated', 'unchanged')"
    return f"""source_pages AS (SELECT page_id, url, html FROM moved), {_LINKS},
site_pages AS (SELECT coalesce({_NORMAL_URL}, url) AS nurl, page_id, html FROM moved),
site AS (SELECT nurl AS url, min(page_id) AS page_id, arg_min(html, page_id) AS html, count(*) FILTER ({renewals}) AS renewals FROM site_pages GROUP BY nurl),
known AS (SELECT url, page_id, renewals, {code} AS code, lower(url || ' ' || {_TITLE} || ' ' || html[1:2000]) AS hay, k.content_hash AS old FROM site LEFT JOIN state k USING (url)),
met AS (SELECT *, {_OUTCOME} AS outcome FROM known),
ruled AS (SELECT page_id, pos, url, {_RULE} AS rule FROM links),
page_links AS (SELECT page_id, list(url ORDER BY pos) FILTER (rule = 'candidate') AS nl FROM ruled GROUP BY page_id),
f AS (SELECT met.url, page_id, code, outcome, renewals, CASE WHEN {followed} THEN coalesce(nl, []) ELSE [] END AS nl FROM met LEFT JOIN page_links USING (page_id)),
seed_rows AS (SELECT pos, url, {_RULE} AS rule FROM (SELECT page_id AS pos, {_NORMAL_URL} AS url FROM moved WHERE {seeds}) WHERE url IS NOT NULL),
seed_first AS (SELECT url, min(pos) AS p FROM seed_rows WHERE rule = 'candidate' GROUP BY url ORDER BY p LIMIT {budget}),
c AS (SELECT 0::BIGINT AS order_no, NULL::VARCHAR AS url, -1 AS depth, 0 AS code, ''::VARCHAR AS outcome, 0::BIGINT AS renewals, (SELECT list({{'url': url, 'depth': 0}} ORDER BY p) FROM seed_first) AS queue,
    (SELECT list(url ORDER BY p) FROM seed_first) AS ever, 0 AS good, (SELECT count(*) FROM seed_first) AS n_queued, (SELECT count(*) FROM seed_rows WHERE rule = 'candidate' AND url NOT IN (SELECT url FROM seed_first)) AS n_budget,
    (SELECT count(*) FROM seed_rows JOIN seed_first USING (url) WHERE pos > p) AS n_duplicate
  UNION ALL SELECT order_no + 1, url, depth, code, outcome, renewals, rest || list_transform(fresh[:room], lambda x: {{'url': x, 'depth': depth + 1}}), ever || fresh[:room], good, len(fresh[:room]), len(fresh) - len(fresh[:room]), len(nl) - len(fresh)
  FROM (SELECT *, {budget} - good - len(rest) AS room, list_filter(nl, lambda x: NOT list_contains(ever, x)) AS fresh
    FROM (SELECT order_no, queue[1].url AS url, queue[1].depth AS depth, coalesce(f.code, 404) AS code, coalesce(f.outcome, 'http_error') AS outcome, coalesce(f.renewals, 0) AS renewals, queue[2:] AS rest, ever,
      good + (coalesce(f.outcome, '') IN ('new', 'updated'))::INT AS good, CASE WHEN queue[1].depth < 8 THEN coalesce(f.nl, []) ELSE [] END AS nl FROM c LEFT JOIN f ON f.url = queue[1].url WHERE len(queue) > 0)))
"""


_WHOLE_CRAWL = _sequential("true", 10_000_000, "200", "false")
_TIGHT_CRAWL = _sequential("page_id % 4 = 1", 40, "CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 7 = 0 THEN 403 ELSE 200 END", "page_id % 3 = 0")
_CHUNK_FILE = f"SELECT doc_id::VARCHAR AS chunk_id, 'https://hub.example.com/' || (doc_id // 5) AS url, source, lang, text FROM documents"

#: The first step of the loop for all questions; a catalog that doesn't change brings nothing new in a second one.
_LOOP = f"""{_STATE}, {_RANKED.replace('rank <= 10', 'rank <= 5')}, hit AS (SELECT query_id, rank, url FROM ranked WHERE url IN (SELECT url FROM state)),
idle AS (SELECT row_number() OVER (ORDER BY pos) AS rank, url FROM state WHERE status IN ('PENDING', 'FAILED') QUALIFY rank <= 5),
wanted AS (SELECT query_id, rank, url FROM hit UNION ALL SELECT query_id, rank, url FROM asked_q, idle WHERE query_id NOT IN (SELECT query_id FROM hit)),
picked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM wanted QUALIFY nth <= 3),
site_pages AS (SELECT min(page_id) AS page_id, url, arg_min(html, page_id) AS html FROM moved GROUP BY url HAVING url IN (SELECT url FROM picked)),
{(_H_PARTS + ',' + _VISIBLE).replace('FROM pages', 'FROM site_pages')}, groups AS ({_PAGE_GROUPS}), {_CHUNKED},
corpus AS (SELECT chunk_id, {_strip('text')} AS text, title, page_id * 1000000 + chunk_no AS pos FROM chunk_rows JOIN site_pages USING (url)),
questions AS (SELECT conv_id AS query_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
{_KEYWORD.replace('<= 12', '<= 5')}, best AS (SELECT query_id, max(relevance) AS best FROM kw GROUP BY query_id),
counts AS (SELECT query_id, count(*) AS n FROM picked GROUP BY query_id)"""

ORACLES: dict[str, str] = {
    "knowledge_loop": f"""WITH RECURSIVE {_LOOP} SELECT query_id, coalesce(sign(n), 0)::INT AS steps, coalesce(n, 0) AS ingested, best, coalesce(best >= 0.28, false) AS enough
        FROM questions LEFT JOIN best USING (query_id) LEFT JOIN counts USING (query_id)""",
    "hybrid_search": f"{_ALL} SELECT query_id, rank, chunk_id, title, relevance FROM hybrid",
    "vector_topk": f"WITH {_CORPUS}, {_VECTOR} SELECT query_id, chunk_id, distance, rank FROM vec",
    "vector_topk_batch": """SELECT q.vec_id AS query_id, c.vec_id::VARCHAR AS chunk_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, c.vec_id::VARCHAR) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""",
    "debug_search": f"""WITH {_CORPUS}, v AS (SELECT embedding AS vector FROM corpus WHERE embedding IS NOT NULL ORDER BY pos LIMIT 1),
        d AS (SELECT c.*, round(1 - list_cosine_similarity(vector, embedding), 6) AS distance FROM corpus c, v WHERE embedding IS NOT NULL)
        SELECT row_number() OVER (ORDER BY distance, chunk_id) AS rank, chunk_id, title, url, greatest(0, least(1, 1 - distance)) AS relevance, text[1:200] AS preview FROM d QUALIFY rank <= 5""",
    "vector_recall": "SELECT count(*) FILTER (vec_id % 20 = 0) AS n_queries, count(*) FILTER (vec_id % 20 = 0) * least(10, count(*)) AS n_exact, true AS enough FROM embeddings",
    "keyword_search": f"WITH {_CORPUS}, {_KEYWORD} SELECT query_id, chunk_id, relevance, rank FROM kw",
    "rrf_scores": f"WITH {_CORPUS}, {_VECTOR}, {_KEYWORD}, {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score FROM rrf",
    "rrf_fuse": f"WITH {_CORPUS}, {_VECTOR}, {_KEYWORD}, {_FUSED} SELECT query_id, position, chunk_id, round(score, 9) AS score, round(relevance, 6) AS relevance FROM fused",
    "authorized_filter": f"WITH {_CORPUS} SELECT chunk_id, access FROM corpus WHERE access IN ('authenticated', 'authorized')",
    "context_sufficient": f"""{_ALL}, per AS (SELECT q.query_id, {_terms('q.question')} AS terms, count(h.chunk_id) AS n_chunks, max(h.relevance) AS best,
        string_agg(lower(h.title || ' ' || h.section || ' ' || h.text), ' ') AS blob FROM questions q LEFT JOIN hybrid h USING (query_id) GROUP BY q.query_id, q.question),
        s AS (SELECT *, coalesce(len(list_filter(terms, lambda t: contains(blob, t))), 0)::INT AS hits FROM per)
        SELECT query_id, n_chunks, best, hits, CASE WHEN n_chunks = 0 OR best < 0.28 THEN false WHEN len(terms) = 0 OR best >= 0.55 THEN true
        ELSE hits >= greatest(1, least(2, (len(terms) + 1) // 2)) END AS sufficient, coalesce(best >= 0.28, false) AS any_relevant FROM s""",
    "context_blocks": f"{_ALL}, {_BLOCKS} SELECT query_id, rank, length(block) AS block_chars, chars, sha256(regexp_replace(block, 'relevance=[0-9.]+', '', 'g')) AS block_sha256 FROM budget",
    "source_list": f"""{_ALL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, url, section ORDER BY rank) AS nth FROM hybrid QUALIFY nth = 1)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, title, url, section, round_even(least(1, greatest(0, relevance)), 4) AS relevance FROM f""",
    "build_prompt": f"""{_ALL}, {_BLOCKS}, ctx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM budget GROUP BY query_id),
        p AS (SELECT query_id, 'Retrieved passages:' || chr(10) || coalesce(context, '{NO_PASSAGES}') || chr(10) || chr(10) || 'User question:' || chr(10) || question || chr(10) || chr(10)
        || '{_RULES}' AS prompt FROM questions LEFT JOIN ctx USING (query_id))
        SELECT query_id, length(prompt) AS chars, sha256(regexp_replace(prompt, 'relevance=[0-9.]+', '', 'g')) AS prompt_sha256 FROM p""",
    "expand_query": f"""WITH {_PAIRS}, p AS (SELECT *, {_strip("coalesce(lag(question) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS previous FROM turns)
        SELECT conv_id, turn, CASE WHEN previous = '' OR lower(previous) = lower(question) THEN question
        ELSE question || chr(10) || chr(10) || 'Previous question in this conversation: ' || previous END AS query FROM p""",
    "conversation_tail": f"WITH {_PAIRS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, question, answer FROM turns QUALIFY back <= 4",
    "history_text": f"""WITH {_PAIRS} SELECT conv_id, 'Previous question: ' || arg_max(question, turn) || chr(10) || 'Previous answer: ' || arg_max(answer, turn)[1:500] AS history FROM turns GROUP BY conv_id""",
    "content_hash": f"SELECT doc_id, sha256({_normal('text')}) AS content_hash FROM documents",
    "text_normalize_hash": f"SELECT doc_id, length({_normal('text')}) AS chars, md5({_normal('text')}) AS normal_md5 FROM documents",
    "content_changed": "SELECT doc_id, doc_id % 7 <> 0 AS unchanged FROM documents",
    "query_terms": f"SELECT conv_id, turn, array_to_string({_terms('text')}, ' ') AS terms FROM conversations",
    "query_terms_score": f"WITH {_PAIRS} SELECT conv_id, turn, len(list_filter({_terms('question')}, lambda t: contains(lower(answer), t)))::INT AS score FROM turns",
    "keywords_top8": f"SELECT conv_id, turn, array_to_string({_terms('text', hybrid_stopwords('Knowledge Base'))}[1:8], ' ') AS keywords FROM conversations",
    "token_count": "SELECT doc_id, ((length(coalesce(text, '')) + 3) // 4)::INT AS tokens FROM documents",
    "truncate_tokens": "SELECT doc_id, md5(CASE WHEN (length(text) + 3) // 4 <= 100 THEN text ELSE text[1:400] END) AS cut_md5 FROM documents",
    "overlap_suffix": "SELECT doc_id, md5(right(coalesce(text, ''), 600)) AS suffix_md5 FROM documents",
    "slug_document_id": f"SELECT page_id, {_slug('url', 'chunk')} AS slug, {_slug('url', 'document')} || '-' || right({_slug('url', 'page')}, 12) AS document_id FROM pages",
    "chunk_id": f"""SELECT doc_id, {_slug('lang', 'intro')} || '-' || CASE WHEN length(doc_id::VARCHAR) < 4 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END || '-'
        || sha1(source || '|' || lang || '|' || doc_id || '|' || text[1:200])[1:12] AS chunk_id FROM documents""",
    "whitespace_normalize": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: true) AS ls FROM documents)
        SELECT doc_id, md5(trim(regexp_replace(array_to_string(ls, chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS normal_md5 FROM l""",
    "footer_flag": f"""WITH {_LINES}, m AS (SELECT doc_id, {_strip("lower(CASE WHEN pos % 5 = 0 THEN '© ' || text ELSE text END)")} AS low FROM lines) SELECT doc_id, count(*) FILTER ({_FOOTER}) AS n_footer FROM m GROUP BY doc_id""",
    "markdown_links": r"""WITH m AS (SELECT doc_id, '[a b](https://hub.example.com/' || doc_id || ') ' || text || ' [z](http://x.example/)' AS t FROM documents),
        e AS (SELECT doc_id, regexp_extract_all(t, '\[([^\]]+)\]\((https?://[^)]+)\)', 1) AS ls, regexp_extract_all(t, '\[([^\]]+)\]\((https?://[^)]+)\)', 2) AS us FROM m)
        SELECT doc_id, unnest(range(len(ls)))::INT AS pos, unnest(ls) AS label, unnest(us) AS url FROM e""",
    "redact_secrets": f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5, contains({_REDACTED}, '=***') AS had_secret FROM documents",
    "safe_error": f"SELECT doc_id, md5({_ERROR}) AS error_md5 FROM documents",
    "url_normalize": f"SELECT page_id, {_NORMAL_URL} AS url FROM pages",
    "url_classify": f"""SELECT page_id, {_HOST} AS host, {_IN_HOSTS} AS internal, lower({_part('url', 1)}) = 'https' AND {_IN_HOSTS} AS allowed,
        NOT {_ends([*ASSET_ENDINGS, *DOCUMENT_ENDINGS])} AS page, {_ends(DOCUMENT_ENDINGS)} AS document FROM pages""",
    "url_log_path": f"SELECT page_id, coalesce(nullif({_PATH}, ''), '/') AS path FROM pages",
    "url_page_slug": r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)\Ahttps?://', ''), '#.*\z', ''), '[^a-zA-Z0-9._-]+', '_', 'g'), '\A_+|_+\z', '', 'g'), ''), 'root')[1:120]
        || '_' || sha1(url)[1:10] AS slug FROM pages""",
    "login_signal": f"SELECT page_id, {_any(_HOST, LOGIN_HOSTS)} OR NOT ({_IN_HOSTS}) OR {_any(f'lower({_PATH})', LOGIN_PATHS_ON_SITE)} AS login FROM pages",
    "signin_title": f"SELECT page_id, {_any('''lower(regexp_extract(html, '<title>([^<]*)</title>', 1))''', SIGN_IN_TITLES)} AS sign_in FROM pages",
    "access_denied": f"SELECT page_id, page_id % 50 = 0 OR {_any('''lower(url || '  ' || html[1:2000])''', DENIED_PHRASES)} AS denied FROM pages",
    "html_title": f"SELECT page_id, {_plain(_TITLE)} AS title FROM pages",
    "block_dedupe": f"""WITH {_LINES}, k AS (SELECT *, lower({_strip('text')}) AS key, row_number() OVER (PARTITION BY doc_id, kind = 'heading', lower({_strip('text')}) ORDER BY pos) AS nth FROM lines)
        SELECT doc_id, pos::INT AS pos, kind, md5(text) AS text_md5 FROM k WHERE kind = 'heading' OR nth = 1 OR length(key) >= 180""",
    "chunk_fixed_windows": """WITH w AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 4000 THEN 1 ELSE 1 + ceil((length(text) - 4000) / 3400.0)::BIGINT END)) AS i FROM documents)
        SELECT doc_id, i::INT AS piece, length(text[i * 3400 + 1 : i * 3400 + 4000]) AS chars, md5(text[i * 3400 + 1 : i * 3400 + 4000]) AS text_md5 FROM w""",
    "chunk_token_windows": r"""WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+[ \t-\r]*\z|[ \t-\r]*[^ \t-\r]+') AS ts FROM documents),
        w AS (SELECT doc_id, ts, unnest(range(CASE WHEN len(ts) = 0 THEN 0 WHEN len(ts) <= 200 THEN 1 ELSE 1 + ceil((len(ts) - 200) / 170.0)::BIGINT END)) AS i FROM l),
        c AS (SELECT doc_id, i, array_to_string(ts[i * 170 + 1 : i * 170 + 200], '') AS text FROM w)
        SELECT doc_id, i::INT AS piece, length(text)::INT AS chars, md5(text) AS text_md5 FROM c""",
    "section_groups": f"""WITH {_LINES}, g AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS group_no FROM lines),
        r AS (SELECT doc_id, group_no, trim(ltrim(arg_min(text, pos), '# ')) AS heading, trim(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (text <> '')) AS text FROM g GROUP BY ALL)
        SELECT doc_id, group_no, md5(heading) AS heading_md5, md5(text) AS text_md5 FROM r WHERE text <> ''""",
    "normalize_records": f"SELECT doc_id::VARCHAR AS id, md5({_strip('text')}) AS text_md5, doc_id AS pos FROM documents WHERE {_strip('text')} <> ''",
    "index_full": f"WITH {_RECORDS} SELECT id, url, content_hash FROM records",
    "index_incremental": f"WITH {_RECORDS} SELECT * FROM after",
    "index_stale": f"WITH {_RECORDS} SELECT * FROM stale",
    "index_stats": f"""WITH {_RECORDS} SELECT 'incremental' AS mode, (SELECT count(*) FROM edited) AS loaded, (SELECT count(*) FROM fresh) AS upserted,
        (SELECT count(*) FROM edited) - (SELECT count(*) FROM fresh) AS skipped_existing, 0::BIGINT AS skipped_invalid, (SELECT count(*) FROM stale) AS stale, (SELECT count(*) FROM after) AS collection_count""",
    "index_hashes_by_url": f"WITH {_RECORDS} SELECT url, count(DISTINCT content_hash)::INT AS n, md5(string_agg(DISTINCT content_hash, '' ORDER BY content_hash)) AS hashes_md5 FROM records GROUP BY url",
    "index_stream": f"WITH {_RECORDS} SELECT id, url, content_hash FROM records",
    "crawl_decisions": f"WITH {_DECIDED} SELECT pos, url, depth, decision FROM decided",
    "crawl_stats": f"""WITH {_DECIDED} SELECT count(*) FILTER (decision = 'queued') AS total_pages_discovered, count(DISTINCT url) FILTER (decision = 'external') AS external_links,
        count(DISTINCT url) FILTER (decision = 'document_link') AS document_links, count(*) FILTER (decision = 'duplicate') AS duplicate_links, count(DISTINCT url) FILTER (decision = 'duplicate') AS duplicate_urls,
        count(*) FILTER (decision = 'non_html_asset') AS non_html_skipped, count(*) FILTER (decision = 'robots_disallowed') AS robots_blocked, count(*) FILTER (decision = 'max_depth_exceeded') AS max_depth_reached,
        count(*) FILTER (decision IN ('not_approved_https_url', 'document_link', 'non_html_asset', 'robots_disallowed', 'max_depth_exceeded', 'max_pages_budget')) AS skipped_pages FROM decided""",
    "crawl_outcomes": f"""WITH {_KNOWN_STATE}, f AS (SELECT p.page_id, p.url, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 403 ELSE 200 END AS code, sha256({_normal('html')}) AS hash, s.content_hash AS old,
        lower(url || ' ' || {_TITLE} || ' ' || html[1:2000]) AS hay FROM moved p LEFT JOIN (SELECT url, content_hash FROM state) s USING (url)),
        o AS (SELECT page_id, url, CASE WHEN {_any(_HOST, LOGIN_HOSTS)} OR {_HOST} <> 'hub.example.com' OR {_any(f'lower({_PATH})', LOGIN_PATHS_ON_SITE)} THEN 'session_expired' WHEN code IN (401, 403) THEN 'access_denied' WHEN code >= 400 THEN 'http_error'
        WHEN {_any('hay', DENIED_PHRASES)} THEN 'access_denied' WHEN coalesce(old, '') <> '' AND old = hash THEN 'unchanged' WHEN coalesce(old, '') <> '' THEN 'updated' ELSE 'new' END AS outcome FROM f)
        SELECT *, CASE outcome WHEN 'session_expired' THEN 'PROCESSING' WHEN 'access_denied' THEN 'ACCESS_DENIED' WHEN 'http_error' THEN 'FAILED' WHEN 'unchanged' THEN 'SKIPPED' WHEN 'updated' THEN 'UPDATED' ELSE 'PROCESSED' END AS status FROM o""",
    "catalog_rank": f"WITH {_STATE}, {_RANKED} SELECT query_id, rank, url, score FROM ranked",
    "url_rank": f"""WITH {_MOVED}, rows AS (SELECT DISTINCT {_NORMAL_URL} AS url FROM moved WHERE {_HOST} = 'hub.example.com'), hay AS (SELECT url, url AS haystack FROM rows), {_RANKED.replace("arg_min(text, turn)", "arg_min(text, turn) || ' example com'")} SELECT query_id, rank, url, score FROM ranked""",
    "catalog_fallback": f"""WITH {_STATE}, {_RANKED}, hit AS (SELECT query_id, rank, url, 'ranked' AS kind FROM ranked WHERE url IN (SELECT url FROM state)),
        idle AS (SELECT row_number() OVER (ORDER BY pos) AS rank, url FROM state WHERE status IN ('PENDING', 'FAILED') QUALIFY rank <= 10),
        fall AS (SELECT query_id, rank, url, 'fallback' AS kind FROM asked_q, idle WHERE query_id NOT IN (SELECT query_id FROM hit)), out AS (FROM hit UNION ALL FROM fall)
        FROM out UNION ALL SELECT query_id, 1, 'https://hub.example.com/', 'start' FROM asked_q WHERE query_id NOT IN (SELECT query_id FROM out)""",
    "retry_urls": f"WITH {_STATE} SELECT url FROM state WHERE status IN ('FAILED', 'PENDING', 'PROCESSING')",
    "status_counts": f"WITH {_STATE} SELECT status, count(*) AS n FROM state GROUP BY status",
    "state_upsert": """WITH e AS (SELECT 'u' || user_id AS url, arg_max(event_type, (ts, event_id)) AS error FROM events GROUP BY user_id), s AS (SELECT 'u' || range AS url FROM range(10))
        SELECT url, CASE WHEN s.url IS NULL THEN '' ELSE 'kept' END AS title, CASE WHEN s.url IS NULL THEN '' ELSE 'h' END AS content_hash, CASE WHEN e.url IS NULL THEN 'PROCESSED' ELSE 'FAILED' END AS status,
        coalesce(e.error, '') AS error, CASE WHEN e.url IS NULL THEN '' ELSE '2000-01-01T00:00:00Z' END AS last_updated, CASE WHEN s.url IS NULL THEN '' ELSE 'd' END AS document_links FROM s FULL JOIN e USING (url)""",
    "html_headings": f"WITH {_H_PARTS} SELECT page_id, 0 AS pos, 'h1' AS level, h1 AS text FROM h_parts WHERE h1 <> ''",
    "html_links": f"""WITH {_PAGES}, {_LINKS} SELECT page_id, pos, url, text, {_IN_HOSTS} AS internal FROM links""",
    "html_nav": """WITH n AS (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=')) AS n FROM pages) SELECT page_id, 0 AS pos, 'nav' AS label, n::INT AS n_items FROM n WHERE n > 0""",
    "html_visible_text": f"WITH {_VISIBLE} SELECT page_id, visible_text, sha256({_normal('title || chr(10) || visible_text')}) AS content_hash FROM visible",
    "html_clean": rf"WITH {_H_PARTS} SELECT page_id, cleaned_text, len(regexp_extract_all(cleaned_text, '\[([^\]]+)\]\((https?://[^)]+)\)'))::INT AS n_links FROM h_clean",
    "html_blocks": f"WITH {_H_PARTS} SELECT page_id, pos, kind, text, heading, section, level FROM h_blocks",
    "chunk_documents": f"WITH RECURSIVE {_H_PARTS}, {_VISIBLE}, groups AS ({_PAGE_GROUPS} UNION ALL {_DOC_GROUPS}), {_CHUNKED} SELECT * EXCLUDE (title, key) FROM chunk_rows",
    "sections_rollup": f"""WITH RECURSIVE {_H_PARTS}, {_VISIBLE}, groups AS ({_PAGE_GROUPS}), {_CHUNKED} SELECT document_id, url, any_value(section) AS sections, count(*) AS chunk_count FROM chunk_rows GROUP BY document_id, url, key""",
    "line_dedupe": rf"""WITH RECURSIVE l AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}])\z', ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents),
        f AS (SELECT doc_id, ls, 0 AS n, []::VARCHAR[] AS kept, []::VARCHAR[] AS recent FROM l
        UNION ALL SELECT doc_id, ls, n + 1, CASE WHEN again THEN kept ELSE kept || [line] END, CASE WHEN again OR key = '' THEN recent ELSE (recent || [key])[-40:] END
        FROM (SELECT *, key <> '' AND length(key) < 120 AND list_contains(recent, key) AS again FROM (SELECT *, ls[n + 1] AS line, lower({_strip('ls[n + 1]')}) AS key FROM f WHERE n < len(ls)))),
        t AS (SELECT doc_id, array_to_string(kept, chr(10)) AS text FROM f WHERE n = len(ls)) SELECT doc_id, length(text)::INT AS chars, md5(text) AS text_md5 FROM t""",
    "hash_embedding": """WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, h FROM h),
        s AS (SELECT doc_id, (i % 32)::INT AS slot, sum((('0x' || h[2 * i + 1 : 2 * i + 2])::INT % 31) / 31.0::DOUBLE) AS x FROM b GROUP BY ALL),
        a AS (SELECT doc_id, unnest(range(32))::INT AS slot FROM documents), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY doc_id)
        SELECT doc_id, slot, round(coalesce(x, 0) / coalesce(nullif(norm, 0), 1), 6) AS value FROM a LEFT JOIN s USING (doc_id, slot) LEFT JOIN n USING (doc_id)""",
    "bfs_frontier": f"WITH {_MOVED}, {_FRONTIER} SELECT url, depth, order_no FROM visited",
    "crawl_run": f"WITH RECURSIVE {_KNOWN_STATE}, {_WHOLE_CRAWL} SELECT url, depth, code AS status_code, outcome, {_STATUS} AS status FROM c WHERE order_no > 0",
    "crawl_budget": f"WITH RECURSIVE {_KNOWN_STATE}, {_TIGHT_CRAWL} SELECT order_no, url, depth, code AS status_code, outcome, renewals FROM c WHERE order_no > 0",
    "crawl_budget_links": f"""WITH RECURSIVE {_KNOWN_STATE}, {_TIGHT_CRAWL}, own AS (SELECT order_no, unnest(['queued', 'max_pages_budget', 'duplicate']) AS decision, unnest([n_queued, n_budget, n_duplicate]) AS n FROM c
        UNION ALL SELECT 0, rule, count(*) FROM seed_rows WHERE rule <> 'candidate' GROUP BY rule
        UNION ALL SELECT order_no, CASE WHEN rule = 'candidate' THEN 'max_depth_exceeded' ELSE rule END AS decision, count(*) FROM c JOIN f USING (url) JOIN ruled USING (page_id)
        WHERE c.outcome IN ('new', 'updated', 'unchanged') AND (rule <> 'candidate' OR depth >= 8) GROUP BY ALL) SELECT order_no, decision, n FROM own WHERE n > 0""",
    "refresh_run": f"""WITH {_KNOWN_STATE}, f AS (SELECT m.url, 200 AS code, lower(m.url || ' ' || {_TITLE} || ' ' || html[1:2000]) AS hay, s.content_hash AS old FROM (SELECT url, arg_min(html, page_id) AS html FROM moved GROUP BY url) m LEFT JOIN state s ON m.url = s.url),
        o AS (SELECT url, {_OUTCOME} AS outcome FROM f) SELECT url, {_STATUS} AS status FROM o""",
    "targeted_ingest": f"""WITH RECURSIVE {_H_PARTS}, {_VISIBLE}, groups AS ({_PAGE_GROUPS}), {_CHUNKED}, asked AS (SELECT url FROM pages ORDER BY page_id LIMIT 3)
        SELECT url, count(DISTINCT chunk_id) AS chunks, (SELECT count(*) FROM pages WHERE url IN (SELECT url FROM asked))::INT AS ingested, 0 AS without_session FROM chunk_rows WHERE url IN (SELECT url FROM asked) GROUP BY url""",
    "requeue_expired": "SELECT 'p' || page_id AS url, row_number() OVER (ORDER BY page_id % 10 <> 0, page_id) AS order_no FROM pages",
    "page_files": rf"""WITH {_MOVED}, f AS (SELECT url, arg_min(html, page_id) AS html FROM moved GROUP BY url) SELECT url, url AS final_url, 200 AS status_code, {_TITLE} AS page_title, sha256({_normal('html')}) AS content_hash, md5(html) AS html_md5 FROM f""",
    "page_runs": rf"""WITH {_MOVED}, f AS (SELECT url, arg_min(html, page_id) AS html FROM moved GROUP BY url)
        SELECT url, url AS final_url, 200 AS status_code, {_TITLE} AS page_title, sha256({_normal('html')}) AS content_hash, md5(html) AS html_md5 FROM f""",
    "page_run_stream": f"""WITH {_MOVED}, f AS (SELECT url, arg_min(html, page_id) AS html FROM moved GROUP BY url)
        SELECT url, (length(html) % 2)::INT AS batch, md5(html) AS html_md5 FROM f""",
    "page_file_failures": "SELECT page_id::VARCHAR AS page, 'not a JSON page' AS error FROM pages WHERE page_id % 3 = 0",
    "chunk_files": f"WITH c AS ({_CHUNK_FILE}) SELECT chunk_id, url, source AS page_title, lang AS section, url AS document_id, md5(text) AS text_md5 FROM c",
    "chunk_runs": f"""WITH c AS ({_CHUNK_FILE})
        SELECT chunk_id, url, source AS page_title, lang AS section, url AS document_id, md5(text) AS text_md5, NULL::VARCHAR AS failure FROM c
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'not a JSON chunk' FROM range(2)""",
    "nested_chunk_files": f"WITH c AS ({_CHUNK_FILE}) SELECT chunk_id, url, url AS document_id, md5(text) AS text_md5 FROM c",
    "state_round_trip": f"WITH {_STATE} SELECT url, title, content_hash, status, url || '/a.pdf' AS document_links FROM state",
    "index_get_by_ids": f"WITH {_RECORDS} SELECT id, url, md5(text) AS text_md5 FROM records WHERE id IN (SELECT (vec_id * 2)::VARCHAR FROM embeddings)",
    "index_get_by_metadata": f"WITH {_RECORDS} SELECT id, url FROM records WHERE url = 'https://hub.example.com/7'",
    "index_rewrites": f"""WITH {_RECORDS}, p AS (SELECT string_agg(id, ',' ORDER BY id) AS peek FROM (SELECT id FROM records ORDER BY id LIMIT 5)), h AS (SELECT string_agg(id, ',' ORDER BY id) AS peek FROM (SELECT id FROM before ORDER BY id LIMIT 5))
        SELECT 0 AS step_no, 'full' AS step, (SELECT count(*) FROM records) AS records, 0 AS live, 'none' AS model, peek FROM p UNION ALL SELECT 1, 'incremental', (SELECT count(*) FROM records), 1, 'none', peek FROM p
        UNION ALL SELECT 2, 'clear', 0, NULL, 'none', '' UNION ALL SELECT 3, 'half', (SELECT count(*) FROM before), 2, 'none', peek FROM h""",
    "index_peek": f"WITH {_RECORDS} SELECT id, url FROM records ORDER BY id LIMIT 5",
    "health_report": """SELECT * FROM (VALUES ('filled', 'healthy', NULL, NULL, 1, 32), ('no model', 'unhealthy', 'llm_config', NULL, 1, 32), ('no embedder', 'unhealthy', 'embedding_config', NULL, 1, NULL),
        ('broken embedder', 'unhealthy', 'embedding', 'ValueError', 1, NULL), ('empty', 'unhealthy', 'empty_index', NULL, 0, 32)) v(name, status, failure_point, error, k, dimensions)""".replace("SELECT *", "SELECT name, status, failure_point, error, k * (SELECT count(*) FROM documents) AS documents, dimensions"),
    "crawl_report": f"""WITH {_DECIDED}, s AS (SELECT 'skipped' AS part, decision AS name, count(*) AS n FROM decided WHERE decision NOT IN ('queued', 'duplicate', 'external', 'invalid') GROUP BY decision),
        f AS (SELECT CASE WHEN page_id % 17 = 0 THEN 'http_error' ELSE 'ACCESS_DENIED' END AS name, count(*) AS n FROM pages WHERE page_id % 17 = 0 OR page_id % 19 = 0 GROUP BY ALL) FROM s UNION ALL SELECT 'failed', name, n FROM f""",
    "process_report": f"WITH {_H_PARTS}, c AS (SELECT count(*) AS n FROM h_clean WHERE cleaned_text <> '') SELECT (SELECT count(*) FROM pages)::INT AS input, n AS processed, 3 AS failed, (SELECT count(*) FROM pages) - n AS skipped FROM c",
    "page_source": f"""WITH {_MOVED}, f AS (SELECT url, arg_min(html, page_id) AS html FROM moved GROUP BY url) SELECT url, url AS final_url, 200 AS status_code, md5(html) AS html_md5 FROM f
        UNION ALL SELECT url || '/missing', url || '/missing', 404, NULL FROM f""",
    "page_fetch_retries": """WITH u AS (SELECT DISTINCT url, md5(url)[1] = '0' AS lost FROM pages)
        SELECT url, CASE WHEN NOT lost THEN 200 END AS status_code, CASE WHEN NOT lost THEN md5('<title>' || url || '</title>') END AS html_md5, CASE WHEN lost THEN 'TimeoutError' END AS error FROM u""",
    "robots_allow": f"""WITH p AS (SELECT page_id, length({_HOST}) % 3 AS k, coalesce(nullif(regexp_extract(url, '(?s)\\A[^:]*://[^/?#]*(.*)\\z', 1), ''), '/') AS path, {_HOST} AS host FROM pages)
        SELECT page_id, CASE WHEN host = '' OR k = 2 THEN true WHEN k = 0 THEN prefix(path, '/en/1') OR NOT prefix(path, '/en/') ELSE NOT prefix(path, '/fr') END AS allowed FROM p""",
    "to_chunks": """SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 2 <> 0 THEN source WHEN doc_id % 3 <> 0 THEN lang ELSE 'Knowledge Base' END AS title, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE source END AS section, '' AS url, md5(text) AS text_md5 FROM documents""",
    "html_fallback": rf"""SELECT doc_id, md5({_strip(f"'# ' || source || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || {_strip("regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g')")} || chr(10) || chr(10) || '[more](https://hub.example.com/x)'")}) AS cleaned_md5 FROM documents""",
    "placeholder_check": "SELECT doc_id, doc_id % 3 = 2 AND trim(source) <> '' AS configured FROM documents",
    "request_validation": f"""WITH m AS (SELECT conv_id, turn, length({_strip("coalesce(text, '')")}) AS n FROM conversations)
        SELECT conv_id, turn, CASE WHEN n NOT BETWEEN 1 AND 4000 THEN 'a message has 1 to 4000 characters' WHEN 40 * length(conv_id::VARCHAR) > 128 THEN 'a conversation id has 128 characters at most'
        WHEN turn NOT BETWEEN 1 AND 20 THEN 'top_k is from 1 to 20' ELSE 'ok ' || n END AS verdict FROM m""",
    "settings": f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a.example' || CASE WHEN {_HOST} <> '' THEN ',' || {_HOST} ELSE '' END ELSE {_HOST} END AS hosts,
        CASE WHEN page_id % 4 = 0 THEN 'd' || page_id ELSE 'm' END AS model FROM pages""",
    "seeds": f"""WITH {_STATE} SELECT 'https://hub.example.com/' AS url, 0 AS place UNION ALL SELECT 'https://hub.example.com/b', 1 UNION ALL SELECT 'https://hub.example.com/a', 2
        UNION ALL SELECT url, NULL FROM state WHERE status IN ('FAILED', 'PENDING', 'PROCESSING')""",
    "unseen_urls": f"WITH {_MOVED}, n AS (SELECT page_id, {_NORMAL_URL} AS url FROM moved) SELECT DISTINCT url FROM n WHERE url NOT IN (SELECT url FROM n WHERE page_id % 2 = 0)",
    "processed_urls": f"WITH {_STATE} SELECT url FROM state WHERE status IN ('PROCESSED', 'UPDATED')",
    "insufficient_answers": rf"""{_ALL}, per AS (SELECT q.query_id, {_terms('q.question')} AS terms, count(h.chunk_id) AS n_chunks, max(h.relevance) AS best, count(DISTINCT (h.title, h.url, h.section)) FILTER (h.chunk_id IS NOT NULL) AS n,
        string_agg(lower(h.title || ' ' || h.section || ' ' || h.text), ' ') AS blob, arg_min(h.text, h.rank) AS first FROM questions q LEFT JOIN hybrid h USING (query_id) GROUP BY q.query_id, q.question),
        s AS (SELECT *, coalesce(n_chunks > 0 AND best >= 0.28 AND (len(terms) = 0 OR best >= 0.55 OR len(list_filter(terms, lambda t: contains(blob, t))) >= greatest(1, least(2, (len(terms) + 1) // 2))), false) AS good FROM per)
        SELECT query_id, NOT good AS refused, md5(CASE WHEN good THEN regexp_extract({_strip('first')}, '\A[^\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*') ELSE '{INSUFFICIENT}' END) AS answer_md5,
        CASE WHEN good THEN n ELSE 0 END::INT AS n_sources FROM s""",
    "state_stream": "SELECT user_id::VARCHAR AS url, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM (SELECT user_id, event_type, ts, event_id FROM events) GROUP BY user_id",
    "conversation_stream": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS question, least(4, row_number() OVER w)::INT AS kept, {_strip("coalesce(lag(text) OVER w, '')")} AS previous
        FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, question, kept, CASE WHEN previous = '' OR lower(previous) = lower(question) THEN question ELSE question || chr(10) || chr(10) || 'Previous question in this conversation: ' || previous END AS query FROM c""",
}
#: The same rows another way.
ORACLES["chunk_documents_sql"] = ORACLES["chunk_documents"]
ORACLES = {k: v for k, v in ORACLES.items() if v}
