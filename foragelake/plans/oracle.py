"""SQL that DuckDB checks the queries with.

Written for DuckDB's dialect: its regular expressions have no lookaround, and `\\b` is ASCII there.
"""

from __future__ import annotations

from foragelake.plans import inputs as I
from foragelake.plans import queries as Q

WS = r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URL = r"(?i)^(https?)://([^/?#:@\s]+)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def part(i: int, x: str = "url") -> str:
    return f"regexp_extract({x}, '{URL}', {i})"


#: The few URLs that browsers write differently: backslashes, white space, marks and letters outside of ASCII, zeros of a port.
_ENCODED = "list_transform(string_split(regexp_replace(replace(trim(url), chr(92), '/'), ':0+(\\d)', ':\\1'), ''), lambda c: CASE WHEN regexp_matches(c, '[^!-~]|[`'']') THEN url_encode(c) ELSE c END)"
_STANDARD = f"CASE WHEN regexp_matches(url, '^\\s*https?:[\\\\/]+.*[\\\\ ]') THEN array_to_string({_ENCODED}, '') ELSE url END"


def parsed(source: str, keep: str = "*") -> str:
    """source with fh (full host), h (host), p (path), lp, port, q (query) of its url."""
    return f"""SELECT {keep if keep != '*' else '* EXCLUDE (std)'}, CASE WHEN regexp_matches(std, '{URL}') THEN lower({part(2, 'std')}) END AS fh,
  CASE WHEN regexp_matches(std, '{URL}') THEN regexp_replace(lower({part(2, 'std')}), '^www\\.', '') END AS h,
  lower({part(1, 'std')}) AS scheme, {part(3, 'std')} AS port, CASE WHEN {part(4, 'std')} = '' THEN '/' ELSE {part(4, 'std')} END AS p, lower({part(4, 'std')}) AS lp, {part(5, 'std')} AS q FROM (SELECT *, {_STANDARD} AS std FROM ({source}) r) s"""


TRACKING = "('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_name','fbclid','gclid')"
QUERY = f"array_to_string(list_filter(string_split(substr(q, 2), '&'), lambda x: lower(string_split(x, '=')[1]) NOT IN {TRACKING}), '&')"


def canonical(host: str) -> str:
    shown = "CASE WHEN port = '' OR port = CASE WHEN scheme = 'https' THEN '443' ELSE '80' END THEN '' ELSE ':' || port END"
    return f"CASE WHEN h IS NOT NULL THEN regexp_replace(scheme || '://' || {host} || {shown} || p || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END, '/$', '') END"


FORUM = "(contains(lp, '/forum/') OR contains(lp, '/forums/') OR contains(lp, '/t/') OR contains(lp, '/topic/') OR contains(lp, '/threads/'))"
KIND = f"""CASE WHEN (h = 'playwright.dev' AND lp LIKE '/docs/api/%') OR (h = 'vitest.dev' AND lp LIKE '/config/%') THEN 'official-api'
  WHEN (h = 'playwright.dev' AND lp LIKE '/docs/%') OR (h = 'vitest.dev' AND lp LIKE '/guide/%') OR h = 'learn.microsoft.com'
    OR (h = 'github.com' AND lp LIKE '/vitest-dev/vitest/%' AND contains(lp, '/docs/')) THEN 'official-docs'
  WHEN h = 'github.com' AND (contains(lp, '/issues/') OR contains(lp, '/discussions/')) THEN 'issue-thread'
  WHEN (h = 'reddit.com' AND contains(lp, '/comments/')) OR (h = 'stackoverflow.com' AND lp LIKE '/questions/%')
    OR (regexp_matches(h || '.', '(^|\\.)(community|forum|forums|discuss|discourse)\\.') AND {FORUM}) THEN 'forum-thread'
  WHEN h = 'npmjs.com' AND lp LIKE '/package/%' THEN 'package-page' ELSE 'community' END"""
SOURCE = "CASE WHEN kind = 'forum-thread' THEN 'community' ELSE kind END"
RANK = "CASE source_kind WHEN 'primary-content' THEN -1 WHEN 'official-docs' THEN 0 WHEN 'official-api' THEN 1 WHEN 'official-discussion' THEN 2 WHEN 'issue-thread' THEN 3 WHEN 'community' THEN 4 WHEN 'package-page' THEN 5 ELSE 6 END"
URLS = f"SELECT page_id, url FROM ({I.oracle(I.URLS)}) a"
WITH_URLS = f"WITH u AS ({parsed(URLS)})"


def decode(x: str) -> str:
    """Entities of a text, once: numbers and five names."""
    tokens = f"regexp_extract_all({x}, '(?i)&(?:#\\d+|#x[\\da-f]+|nbsp|amp|lt|gt|quot);|[^&]+|&')"
    one = r"""CASE WHEN regexp_matches(t, '^&#\d+;$') THEN chr(CAST(regexp_extract(t, '\d+') AS INTEGER))
      WHEN regexp_matches(t, '(?i)^&#x[\da-f]+;$') THEN chr(CAST(('0x' || regexp_extract(t, '(?i)x([\da-f]+)', 1)) AS INTEGER))
      WHEN lower(t) = '&nbsp;' THEN ' ' WHEN lower(t) = '&amp;' THEN '&' WHEN lower(t) = '&lt;' THEN '<'
      WHEN lower(t) = '&gt;' THEN '>' WHEN lower(t) = '&quot;' THEN '"' ELSE t END"""
    return f"array_to_string(list_transform({tokens}, lambda t: {one}), '')"


_TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"
TITLE = f"nullif({decode(collapse(_TITLE))}, '')"


def _section() -> str:
    out = "html"
    for tag in ("body", "article", "main"):
        pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
        out = f"CASE WHEN regexp_matches(html, '{pattern}') THEN regexp_extract(html, '{pattern}', 1) ELSE {out} END"
    for tag in ("script", "style", "noscript", "svg", "template"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return out


_STRIPPED = f"regexp_replace({decode('inner_html')}, '<[^>]+>', ' ', 'g')"
TEXT = f"substr({collapse(_STRIPPED)}, 1, 4000)"
HTML = f"h0 AS ({I.oracle(I.HTML)}), h1 AS (SELECT *, {_section()} AS inner_html FROM h0), h AS (SELECT page_id, url, html, content_type, {TITLE} AS title, {TEXT} AS text FROM h1)"
BOT = "performing security verification|security service|verify you are not a bot|just a moment|checking your browser"
BOT_CHECK = f"regexp_matches(coalesce(title, '') || chr(10) || text, '(?i){BOT}')"
SHELL = "(contains(lower(html), '<script') AND (contains(lower(html), 'id=\"app\"') OR contains(lower(html), 'id=\"root\"')))"
WEAK = f"""(length({collapse('text')}) > 0 AND length({collapse('text')}) < 120 AND ((length({collapse('html')}) > 0 AND length({collapse('text')}) / length({collapse('html')}) < 0.02)
  OR regexp_matches(html, '(?i)enable javascript|javascript required|please turn on javascript')))"""
STATUS = f"CASE WHEN NOT contains(content_type, 'text/html') THEN 'unsupported' WHEN {SHELL} OR length(text) < 40 OR {WEAK} THEN 'needs_headless' ELSE 'ok' END"

STOP = r"(?i)\b(find|current|tell|me|how|to|the|and|with|for|in|a|an)\b"
_WORDS = f"regexp_replace({collapse('query')}, '{STOP}', ' ', 'g')"
IMPORTANT = collapse(_WORDS)
QUESTIONS = f"qs AS ({I.oracle(I.QUESTIONS)}), t AS (SELECT query_id, query, {IMPORTANT} AS terms FROM qs)"
OFFICIAL = "CASE WHEN contains(lower(query), 'vitest') THEN 'site:vitest.dev ' || terms WHEN contains(lower(query), 'playwright') THEN 'site:playwright.dev ' || terms WHEN contains(lower(query), 'edge') THEN 'site:learn.microsoft.com ' || terms ELSE terms || ' official docs' END"

# A page is cut at its result elements; each piece has one link and snippet, in any order of attributes.
_CLASSED = r"[^>]*class=[\"''](?:[^\"'']*\s)?NAME(?:\s[^\"'']*)?[\"''][^>]*>"
_RESULT, _LINK, _SNIPPET = (f"(?is)<{e}{_CLASSED.replace('NAME', n)}" for e, n in (("[a-z]+", "result"), ("a", "result__a"), ("[a-z]+", "result__snippet")))
_HREF = r"replace(coalesce(nullif(regexp_extract(link, '(?i)href=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(link, '(?i)href=''([^'']*)''', 1), ''), regexp_extract(link, '(?i)href=([^\s>\"'']+)', 1)), '&amp;', '&')"
_SERP_OUTCOME = f"""WITH p AS (SELECT doc_id, html, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM ({I.oracle(Q._PAGES)}) x),
  b AS (SELECT doc_id, i, cut[i] AS piece FROM (SELECT doc_id, string_split_regex(h, '{_RESULT}') AS cut FROM p), range(2, 9) r(i) WHERE i <= len(cut)),
  e AS (SELECT doc_id, i, regexp_extract(piece, '{_LINK}', 0) AS link, regexp_replace(regexp_extract(piece, '{_LINK}(.*?)</a>', 1), '<[^>]+>', '', 'g') AS title, regexp_extract(piece, '{_SNIPPET}(.*?)</', 1) AS snippet FROM b),
  u AS (SELECT doc_id, i, {trim('title')} AS title, {trim('snippet')} AS snippet, {_HREF} AS href FROM e),
  g AS (SELECT doc_id, i, title, snippet, CASE WHEN starts_with(href, '//duckduckgo.com/l/') THEN url_decode(regexp_extract(href, 'uddg=([^&]*)', 1)) ELSE href END AS url FROM u WHERE title <> '' AND href <> ''),
  n AS (SELECT doc_id, count(*) AS n, arg_min(title, i) AS title, arg_min(url, i) AS url, arg_min(snippet, i) AS snippet, arg_max(url, i) AS last_url FROM g GROUP BY 1),
  v AS (SELECT doc_id, lower(html) AS low, lower(regexp_replace(html, '<[^>]+>', '', 'g')) AS seen FROM p)
  SELECT doc_id, coalesce(n, 0)::INTEGER AS n, title, url, snippet, last_url, CASE WHEN n > 0 THEN 'ok' WHEN regexp_matches(seen, 'no results found|no more results|did not match any documents') THEN 'NO_RESULTS'
    WHEN regexp_matches(low, 'captcha|challenge|verify you are human|are you a robot|unusual traffic') THEN 'BLOCKED' ELSE 'PARSE_FAILED' END AS outcome FROM v LEFT JOIN n USING (doc_id)"""

ORACLE_SQL = {
    "url_canonical": f"{WITH_URLS} SELECT page_id, {canonical('h')} AS canonical, {canonical('fh')} AS with_www, coalesce(h, lower(url)) AS host_key FROM u",
    "url_dedupe": f"{WITH_URLS} SELECT {canonical('h')} AS canonical, min(page_id) AS first_page, arg_min(url, page_id) AS url, count(*) AS n FROM u GROUP BY 1",
    "host_counts": f"{WITH_URLS} SELECT h AS host, count(*) AS n FROM u GROUP BY 1",
    "source_profile": f"{WITH_URLS}, k AS (SELECT page_id, {KIND} AS kind FROM u), s AS (SELECT *, {SOURCE} AS source_kind FROM k) SELECT page_id, kind, source_kind, kind IN ('issue-thread', 'forum-thread') AS prefers_rendering, ({RANK})::INTEGER AS rank FROM s",
    "html_title": f"WITH {HTML} SELECT page_id, title FROM h",
    "html_fallback_text": f"WITH {HTML} SELECT page_id, text FROM h",
    "entity_decode": f"SELECT page_id, {decode('t')} AS decoded FROM ({I.oracle(Q._ENCODED)}) a",
    "rendered_cleanup": "SELECT page_id, " + collapse(r"regexp_replace(regexp_replace(t, '(?i)(Show more)(\s+Show more)+', '\1', 'g'), '(?i)(Privacy Terms)(\s+Privacy Terms)+', '\1', 'g')") + f" AS cleaned FROM ({I.oracle(Q._RENDERED)}) a",
    "word_excerpt": f"""SELECT doc_id, CASE WHEN {collapse('text')} <> '' THEN len(string_split({collapse('text')}, ' '))::BIGINT END AS words,
      CASE WHEN text = '' THEN NULL WHEN length(text) <= 240 THEN text ELSE regexp_replace(substr(text, 1, 240), '{WS}+$', '') || '…' END AS short,
      CASE WHEN text = '' THEN NULL WHEN length(text) <= 500 THEN text ELSE regexp_replace(substr(text, 1, 500), '{WS}+$', '') || '…' END AS long,
      substr({collapse('text')}, 1, 120) AS support FROM documents""",
    "fetch_status": f"WITH {HTML} SELECT page_id, {SHELL} AS shell, {WEAK} AS weak, {BOT_CHECK} AS bot_check, {STATUS} AS status FROM h",
    "page_profile": f"WITH {HTML}, u AS ({parsed('SELECT * FROM h')}) SELECT page_id, {canonical('u.h')} AS canonical, u.h AS host, {KIND} AS kind, title, {STATUS} AS status, {BOT_CHECK} AS bot_check, substr({collapse('text')}, 1, 180) AS summary FROM u",
    "important_words": f"WITH {QUESTIONS} SELECT query_id, terms AS words, regexp_matches(query, '(?i)reddit|forum|forums|discussion|thread|comments|community|user experience|people recommend') AS discussion, {trim('query')} = '' AS invalid FROM t",
    "query_plan": f"""WITH {QUESTIONS},
      a AS (SELECT query_id, list_filter([{collapse('query')}], lambda x: x <> '') AS f, list_filter([{collapse(OFFICIAL)}, {collapse("'site:github.com ' || terms")}, {collapse("terms || ' discussion'")}], lambda x: x <> '') AS l FROM t),
      b AS (SELECT query_id, f || list_filter(l, lambda x: NOT list_contains(f, x)) AS q FROM a)
      SELECT query_id, (i - 1)::INTEGER AS step, CASE WHEN i = 1 THEN 0 ELSE 1 END::INTEGER AS pass_index, q[i] AS query FROM b, range(1, 5) r(i) WHERE i <= len(q)""",
    "direct_urls": f"""WITH qs AS ({I.oracle(I.QUESTIONS)}),
      m AS (SELECT query_id, unnest(regexp_extract_all(query, '(?i)https?://[^\\s]+')) AS raw, generate_subscripts(regexp_extract_all(query, '(?i)https?://[^\\s]+'), 1) AS i FROM qs),
      u AS ({parsed("SELECT query_id, i, regexp_replace(raw, '[),.;!?\\]]+$', '') AS url FROM m")}),
      d AS (SELECT query_id, c, min(i) AS i FROM (SELECT query_id, i, {canonical('fh')} AS c FROM u) WHERE c IS NOT NULL GROUP BY ALL),
      n AS (SELECT query_id, string_agg(c, ' ' ORDER BY i) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS k FROM d) WHERE k <= 3 GROUP BY 1)
      SELECT qs.query_id, coalesce(urls, '') AS urls FROM qs LEFT JOIN n USING (query_id)""",
    "redirect_unwrap": f"""WITH r AS (SELECT page_id, raw, CASE WHEN starts_with(raw, '//') THEN 'https:' || raw ELSE raw END AS a FROM ({I.oracle(Q._REDIRECTS)}) x)
      SELECT page_id, CASE WHEN regexp_matches(a, '^https?://duckduckgo[.]com/l/[?]') AND regexp_matches(a, '[?&]uddg=[^&]') THEN url_decode(regexp_extract(a, '[?&]uddg=([^&]*)', 1)) ELSE raw END AS url,
      'https://html.duckduckgo.com/html/?q=a+b%26' || page_id AS search_url FROM r""",
    "serp_outcome": _SERP_OUTCOME,
    "search_fallback": f"""SELECT page_id, CASE WHEN u THEN f.backend ELSE p.backend END AS backend, CASE WHEN u THEN f.status ELSE p.status END AS status, CASE WHEN u THEN f.message ELSE p.message END AS message,
      CASE WHEN u THEN p.backend END AS fallback_from, CASE WHEN u THEN p.message END AS fallback_reason FROM ({I.oracle(Q._PRIMARY)}) p LEFT JOIN ({I.oracle(Q._FALLBACK)}) f USING (page_id), LATERAL (SELECT p.status = 'error' AND f.status IS NOT NULL AS u) x""",
    "fetch_fallback": f"""SELECT page_id, CASE WHEN u THEN f.backend ELSE p.backend END AS backend, CASE WHEN u THEN f.status ELSE p.status END AS status, CASE WHEN u THEN f.message ELSE p.message END AS message,
      CASE WHEN u THEN p.backend END AS fallback_from, CASE WHEN u THEN p.message END AS fallback_reason FROM ({I.oracle(Q._PRIMARY)}) p LEFT JOIN ({I.oracle(Q._FALLBACK)}) f USING (page_id), LATERAL (SELECT p.status IN ('error', 'needs_headless') AND f.status IS NOT NULL AS u) x""",
    "ttl_cache_hits": f"""WITH RECURSIVE a AS (SELECT CAST(to_json([user_id::VARCHAR, event_type]) AS VARCHAR) AS key, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
      r AS (SELECT key, event_id, i, false AS hit, ms + {Q.TTL_MS} AS expires FROM a WHERE i = 1
        UNION ALL SELECT a.key, a.event_id, a.i, r.expires > a.ms, CASE WHEN r.expires > a.ms THEN r.expires ELSE a.ms + {Q.TTL_MS} END FROM r JOIN a ON a.key = r.key AND a.i = r.i + 1)
      SELECT key, event_id, hit FROM r""",
    "repo_listing": r"""SELECT CAST(floor(page_id / 20) AS BIGINT) AS repo, 'readme' || chr(10) || chr(10) || 'Top-level contents:' || chr(10) || string_agg(CASE WHEN page_id % 3 = 0 THEN '[dir] ' ELSE '' END || 'n' || page_id, chr(10) ORDER BY page_id) AS text FROM pages GROUP BY 1""",
    "fanout_weak": "",
}
ORACLE_SQL["ttl_cache_stream"] = ORACLE_SQL["ttl_cache_hits"]
ORACLE_SQL["reader_route"] = rf"""{WITH_URLS}, s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS seg FROM u),
  k AS (SELECT *, CASE WHEN fh = 'github.com' THEN CASE WHEN len(seg) >= 5 AND seg[3] = 'blob' THEN 'blob' WHEN len(seg) >= 4 AND seg[3] = 'issues' THEN 'issue' WHEN len(seg) >= 4 AND seg[3] = 'pull' THEN 'pull' WHEN len(seg) = 2 THEN 'repo-root' END END AS shape,
    CASE WHEN h = 'youtube.com' AND p = '/watch' THEN nullif(regexp_extract(q, '[?&]v=([^&]*)', 1), '') END AS video_id, h IS NOT NULL AND lp LIKE '%.pdf' AS pdf FROM s)
  SELECT page_id, shape, CASE WHEN shape IS NOT NULL THEN 'github' WHEN pdf THEN 'pdf' WHEN video_id IS NOT NULL THEN 'youtube' WHEN regexp_matches(url, '^https?://') THEN 'http' ELSE 'unsupported' END AS route,
    CASE WHEN shape = 'blob' THEN 'https://raw.githubusercontent.com/' || seg[1] || '/' || seg[2] || '/' || array_to_string(list_transform(seg[4:], lambda x: replace(replace(x, '%20', ' '), ' ', '%20')), '/') END AS raw_url,
    video_id, CASE WHEN pdf THEN seg[-1] END AS pdf_title FROM k"""
SERP = I.SERP.replace("{urls}", f"({I.oracle(I.URLS)})").replace("{pages}", "pages")
WITH_SERP = f"WITH serp AS ({SERP}), u AS ({parsed('SELECT * FROM serp')})"
GOOD = "status = 'ok' AND latency_ms <= 8000"
ORACLE_SQL["fanout_weak"] = f"""{WITH_SERP}, g AS (SELECT query_id, count(*) FILTER (provider_pos = 0 AND {GOOD}) AS n_results, count(DISTINCT h) FILTER (provider_pos = 0 AND {GOOD}) AS n_hosts FROM u GROUP BY 1)
  SELECT *, n_results < 3 OR n_hosts <= 1 AS weak FROM g"""
ORACLE_SQL["fanout_providers"] = f"""WITH serp AS ({SERP}), g AS (SELECT query_id, provider, provider_pos, bool_or({GOOD}) AS good FROM serp GROUP BY ALL)
  SELECT query_id, coalesce(string_agg(provider, ',' ORDER BY provider_pos) FILTER (good), '') AS providers, coalesce(string_agg(provider, ',' ORDER BY provider_pos) FILTER (NOT good), '') AS skipped FROM g GROUP BY 1"""
_MERGED = f"""k AS (SELECT *, coalesce({canonical('h')}, url) AS key FROM u WHERE {GOOD}),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key, provider_pos ORDER BY rank) AS first FROM k) WHERE first = 1),
  m AS (SELECT query_id, key, arg_max(title, length(title) * 1000000 - provider_pos * 10000 - rank) AS title, arg_min(url, provider_pos * 10000 + rank) AS url,
    arg_max(snippet, length(snippet) * 1000000 - provider_pos * 10000 - rank) AS snippet, count(*) AS n_providers, min(rank) AS best_rank, min(provider_pos * 10000 + rank) AS seen FROM o GROUP BY ALL)"""
ORACLE_SQL["fanout_merge"] = f"""{WITH_SERP}, {_MERGED}
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY n_providers DESC, best_rank, seen) - 1)::INTEGER AS pos, title, url, snippet, n_providers, best_rank FROM m"""
_EVIDENCE = f"""e AS (SELECT CAST(floor((page_id % {I.EXTRA}) / 30) AS BIGINT) AS query_id, page_id AS ordinal, 't' || page_id AS title, url, {SOURCE} AS source_kind,
  CASE WHEN page_id % 7 = 0 THEN 'this is deprecated, not recommended' WHEN page_id % 5 = 0 THEN 'the recommended way' ELSE 'plain' END AS summary, h FROM (SELECT *, {KIND} AS kind FROM u)),
  b AS (SELECT *, {RANK} AS r, min(ordinal) OVER (PARTITION BY query_id, url) AS seen, row_number() OVER (PARTITION BY query_id, url ORDER BY {RANK}, ordinal) AS k FROM e WHERE source_kind <> 'package-page'),
  ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY r, seen) - 1)::INTEGER AS pos FROM b WHERE k = 1)"""
ORACLE_SQL["evidence_rank"] = f"{WITH_URLS}, {_EVIDENCE} SELECT query_id, pos, title, url, source_kind FROM ranked"
ORACLE_SQL["candidate_topk"] = f"""{WITH_SERP}, f AS (SELECT query_id, url, min(rank) AS pos, arg_min(title, rank) AS title, any_value(h) AS h, any_value(lp) AS lp FROM u WHERE provider_pos = 0 GROUP BY 1, 2),
  k AS (SELECT *, {KIND} AS kind, coalesce(h = 'github.com' OR h LIKE '%.github.com', false) AS repo, query_id % 2 = 0 AS talk FROM f),
  s AS (SELECT *, CASE WHEN kind = 'official-docs' THEN 0 WHEN kind = 'official-api' THEN 1 WHEN talk THEN CASE WHEN kind = 'forum-thread' THEN 2 WHEN kind = 'issue-thread' THEN 3 WHEN repo THEN 4 WHEN kind = 'package-page' THEN 6 ELSE 5 END
    ELSE CASE WHEN kind = 'issue-thread' THEN 2 WHEN repo THEN 3 WHEN kind = 'package-page' THEN 5 ELSE 4 END END AS score FROM k)
  SELECT query_id, candidate::INTEGER AS candidate, url, title, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, pos) AS candidate FROM s) WHERE candidate <= 4"""
ORACLE_SQL["tool_call_verdict"] = f"""WITH l AS ({I.oracle(I.LOG)}), f AS (SELECT *, min(pos) FILTER (tool_name = 'web_explore') OVER (PARTITION BY session_id) AS f FROM l),
  m AS (SELECT session_id, bool_or(tool_name = 'web_explore') AS explore_used, coalesce(arg_min(tool_name, pos) FILTER (tool_name IN ('web_explore','web_search','web_fetch','web_fetch_headless')) = 'web_explore', false) AS explore_first,
    count(*) AS tool_calls, count(*) FILTER (tool_name IN ('web_explore','web_search','web_fetch','web_fetch_headless')) AS web_calls,
    count(*) FILTER (tool_name = 'bash' AND regexp_matches(coalesce(command, ''), '(?i)\\b(Invoke-WebRequest|Invoke-RestMethod|curl(?:\\.exe)?|wget|npm\\s+(?:view|search|pack)|pip\\s+index)\\b|https?://') AND pos > f) AS shell_after FROM f GROUP BY 1),
  n AS (SELECT *, session_id % 9 = 0 AS empty FROM m)
  SELECT session_id, explore_used, explore_first, tool_calls, web_calls, shell_after,
    CASE WHEN NOT explore_used THEN 'web_explore was not used' ELSE concat_ws(',', CASE WHEN NOT explore_first THEN 'web_explore was not the first web research tool' END,
      CASE WHEN shell_after > 0 THEN 'network-capable shell fallback after web_explore (' || shell_after || ')' END, CASE WHEN empty THEN 'final answer text was empty' END) END AS notes,
    CASE WHEN NOT explore_used OR empty THEN 'fail' WHEN explore_first AND shell_after = 0 THEN 'pass' ELSE 'mixed' END AS verdict FROM n"""
ORACLE_SQL["fanout_auto"] = f"""{WITH_SERP}, {_MERGED},
  g AS (SELECT query_id, count(*) FILTER (provider_pos = 0 AND {GOOD}) < 3 OR count(DISTINCT h) FILTER (provider_pos = 0 AND {GOOD}) <= 1 AS weak FROM u GROUP BY 1)
  SELECT query_id, rank::INTEGER AS pos, title, url, snippet, 1::BIGINT AS n_providers, rank AS best_rank FROM u JOIN g USING (query_id) WHERE NOT weak AND provider_pos = 0 AND {GOOD}
  UNION ALL SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY n_providers DESC, best_rank, seen) - 1)::INTEGER, title, url, snippet, n_providers, best_rank FROM m JOIN g USING (query_id) WHERE weak"""
ORACLE_SQL["serp_parse_json"] = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'brave' WHEN 1 THEN 'exa' ELSE 'tavily' END AS provider, 0::INTEGER AS rank,
  CASE WHEN page_id % 5 = 0 THEN 'T' || page_id ELSE 'T' END AS title, CASE WHEN page_id % 5 = 2 THEN 'http://a' ELSE 'http://a/' || page_id END AS url,
  CASE page_id % 5 WHEN 0 THEN 'd' WHEN 1 THEN '' ELSE 'c' END AS snippet FROM pages WHERE page_id % 5 < 3"""
ORACLE_SQL["thread_text"] = f"""WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS said FROM conversations),
  g AS (SELECT conv_id, coalesce(string_agg(said, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text) FILTER (said <> ''), '') AS full_text,
    coalesce(string_agg(said, ' ' ORDER BY turn, text), '') AS joined FROM t GROUP BY 1)
  SELECT conv_id, substr(full_text, 1, 24000) AS text, length(full_text) >= 24000 AS truncated, {collapse('joined')} AS transcript FROM g"""
_LINES = r"regexp_split_to_array(content, '\r?\n')"
ORACLE_SQL["changelog_sections"] = rf"""WITH c AS ({I.oracle(Q._CHANGELOG)}), l AS (SELECT log_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM c),
  s AS (SELECT *, count(*) FILTER (starts_with(line, '## ')) OVER (PARTITION BY log_id ORDER BY i) AS section FROM l),
  v AS (SELECT log_id, first(regexp_extract(line, '^##\s+\[?(\d+\.\d+\.\d+)\]?', 1) ORDER BY i) AS version, string_agg(line, chr(10) ORDER BY i) AS body FROM s WHERE section > 0 GROUP BY log_id, section)
  SELECT log_id, version, {trim('body')} AS content, list_transform(string_split(version, '.'), lambda x: x::INTEGER) > [0, 9, 10] AS newer FROM v WHERE version <> ''"""


# --- configuration --------------------------------------------------------------------------------------------------


def _s(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') = 'VARCHAR' THEN json_extract_string({x}, '$.{path}') END"


def _list(x: str, path: str) -> str:
    items = f"json_extract({x}, '$.{path}[*]')"
    return f"CASE WHEN json_type({x}, '$.{path}') = 'ARRAY' AND len(list_filter({items}, lambda e: json_type(e) <> 'VARCHAR')) = 0 THEN list_transform({items}, lambda e: e->>'$') END"


def _in(x: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CASE WHEN {x} IN ({listed}) THEN {x} END"


PROVIDERS = ("duckduckgo", "searxng", "brave", "youcom", "exa", "tavily")


def _layer(x: str) -> str:
    """Columns of one file, named after its column x."""
    search, fetch = "backends.search", "backends.fetch"
    safe = f"json_extract({x}, '$.{search}.options.safesearch')"
    known = f"len(list_filter({x}_names, lambda p: p NOT IN {PROVIDERS})) = 0"
    listed = f"json_type({x}, '$.{search}.fanout.providers') = 'ARRAY'"
    return f"""{_in("(" + _s(x, search + ".provider") + ")", *PROVIDERS)} AS {x}_p, {_in("(" + _s(x, fetch + ".provider") + ")", "http", "firecrawl")} AS {x}_fp,
      {_list(x, search + ".fanout.providers")} AS {x}_names, {_in("(" + _s(x, search + ".fanout.mode") + ")", "off", "on", "auto")} AS {x}_mode0,
      CASE WHEN {x}_mode0 IS NOT NULL AND (NOT coalesce({listed}, false) OR coalesce({known}, false)) THEN {{'mode': {x}_mode0, 'providers': CASE WHEN len({x}_names) > 0 THEN {x}_names END}} END AS {x}_fan,
      CASE WHEN {x}_p = 'searxng' THEN {_s(x, search + ".baseUrl")} END AS {x}_url, CASE WHEN {x}_p IS NOT NULL THEN {_in("(" + _s(x, search + ".fallback") + ")", "duckduckgo")} END AS {x}_fb,
      {_list(x, search + ".options.categories")} AS {x}_cat, {_s(x, search + ".options.language")} AS {x}_lang, CASE WHEN json_type({safe}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND ({safe})::DOUBLE IN (0, 1, 2) THEN ({safe})::INTEGER END AS {x}_safe,
      CASE WHEN {x}_p = 'searxng' AND ({x}_cat IS NOT NULL OR {x}_lang IS NOT NULL OR {x}_safe IS NOT NULL) THEN {{'cat': {x}_cat, 'lang': {x}_lang, 'safe': {x}_safe}} END AS {x}_opt,
      CASE WHEN {x}_fp IS NOT NULL THEN {_s(x, fetch + ".baseUrl")} END AS {x}_furl, CASE WHEN {x}_fp IS NOT NULL THEN {_s(x, fetch + ".apiKey")} END AS {x}_key, CASE WHEN {x}_fp IS NOT NULL THEN {_in("(" + _s(x, fetch + ".fallback") + ")", "http")} END AS {x}_ffb,
      {_list(x, fetch + ".options.formats")} AS {x}_form, CASE WHEN json_type({x}, '$.{fetch}.options.onlyMainContent') = 'BOOLEAN' THEN json_extract({x}, '$.{fetch}.options.onlyMainContent')::BOOLEAN END AS {x}_main,
      CASE WHEN {x}_fp IS NOT NULL AND ({x}_form IS NOT NULL OR {x}_main IS NOT NULL) THEN {{'form': {x}_form, 'main': {x}_main}} END AS {x}_fopt"""


def _over(name: str, switched: str) -> str:
    return f"CASE WHEN {switched} THEN b_{name} ELSE coalesce(b_{name}, a_{name}) END AS {name}"


_FILES = f"c0 AS ({I.oracle(I.CONFIGS)}), c AS (SELECT *, CASE WHEN json_valid(own) THEN own END AS a, CASE WHEN json_valid(project) THEN project END AS b FROM c0)"
_ISSUES = """concat_ws('; ', CASE WHEN provider = 'searxng' AND no_url THEN 'search provider searxng requires backends.search.baseUrl' END,
  CASE WHEN fetch_provider = 'firecrawl' AND coalesce(furl, '') = '' THEN 'fetch provider firecrawl requires backends.fetch.baseUrl' END,
  CASE WHEN fb = 'duckduckgo' AND provider = 'duckduckgo' THEN 'search fallback duckduckgo is only supported when search provider is searxng, brave, youcom, exa, or tavily' END,
  CASE WHEN ffb = 'http' AND fetch_provider <> 'firecrawl' THEN 'fetch fallback http is only supported when fetch provider is firecrawl' END,
  CASE WHEN len(opt.cat) = 0 THEN 'search options.categories must contain at least one category when provided' END,
  CASE WHEN trim(opt.lang) = '' THEN 'search options.language must not be empty when provided' END,
  CASE WHEN len(fopt.form) = 0 THEN 'fetch options.formats must contain at least one format when provided' END,
  CASE WHEN list_contains(fan.providers, 'searxng') AND no_url THEN 'search fanout with searxng requires backends.search.baseUrl' END)"""
ORACLE_SQL["config_merge"] = f"""WITH {_FILES}, l AS (SELECT *, {_layer('a')}, {_layer('b')} FROM c),
  w AS (SELECT *, b_p IS NOT NULL AND b_p <> coalesce(a_p, 'duckduckgo') AS sw, b_fp IS NOT NULL AND b_fp <> coalesce(a_fp, 'http') AS fsw FROM l),
  m AS (SELECT config_id, brave_key, exa_key, coalesce(b_p, a_p, 'duckduckgo') AS provider, coalesce(b_fp, a_fp, 'http') AS fetch_provider,
    {_over('url', 'sw')}, {_over('fb', 'sw')}, {_over('opt', 'sw')}, {_over('fan', 'sw')}, {_over('furl', 'fsw')}, {_over('key', 'fsw')}, {_over('ffb', 'fsw')}, {_over('fopt', 'fsw')} FROM w),
  n AS (SELECT *, coalesce(url, '') = '' AS no_url, list_filter(['duckduckgo', CASE WHEN trim(url) <> '' THEN 'searxng' END, CASE WHEN trim(brave_key) <> '' THEN 'brave' END, CASE WHEN trim(exa_key) <> '' THEN 'exa' END], lambda x: x IS NOT NULL) AS u FROM m)
  SELECT config_id, provider, url AS base_url, fb AS fallback, array_to_string(opt.cat, ',') AS categories, opt.lang AS language, opt.safe AS safesearch, fan.mode AS fanout_mode, array_to_string(fan.providers, ',') AS fanout_providers,
    fetch_provider, furl AS fetch_base_url, key AS api_key, ffb AS fetch_fallback, array_to_string(fopt.form, ',') AS formats, fopt.main AS only_main, {_ISSUES} AS issues, array_to_string(u, ',') AS usable,
    array_to_string([provider] || list_filter(u, lambda x: x <> provider), ',') AS provider_order, CASE WHEN provider = 'searxng' AND no_url THEN 'BACKEND_CONFIG_INVALID' END AS search_code,
    CASE WHEN fetch_provider = 'firecrawl' AND coalesce(furl, '') = '' THEN 'Firecrawl fetch requires backends.fetch.baseUrl.' END AS fetch_message FROM n"""


def _mode(tool: str) -> str:
    own = [_in("(" + _s(x, f"presentation.{path}") + ")", "compact", "preview", "verbose") for path in (f"tools.{tool}.mode", "defaultMode") for x in "ba"]
    return f"coalesce({', '.join(own)}, 'compact') AS {tool}"


ORACLE_SQL["presentation_modes"] = f"WITH {_FILES} SELECT config_id, {', '.join(map(_mode, ('web_explore', 'web_search', 'web_fetch', 'web_fetch_headless')))} FROM c"
ORACLE_SQL["scrape_outcome"] = f"""WITH s0 AS ({I.oracle(I.SCRAPED)}), s AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS v FROM s0),
  f AS (SELECT *, CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || http_status WHEN v IS NULL THEN 'invalid JSON' WHEN json_type(v, '$.success') = 'BOOLEAN' AND NOT json_extract(v, '$.success')::BOOLEAN THEN coalesce({_s('v', 'error')}, 'Firecrawl scrape failed.') END AS failed,
    coalesce({_s('v', 'data.markdown')}, {_s('v', 'data.html')}, '') AS found FROM s),
  g AS (SELECT *, {trim('found')} = '' AS blank FROM f)
  SELECT page_id, CASE WHEN failed IS NOT NULL THEN 'error' WHEN blank THEN 'needs_headless' ELSE 'ok' END AS status, CASE WHEN failed IS NOT NULL THEN url ELSE coalesce({_s('v', 'data.metadata.sourceURL')}, url) END AS url,
    CASE WHEN failed IS NULL AND NOT blank THEN {_s('v', 'data.metadata.title')} END AS title, CASE WHEN failed IS NULL AND NOT blank THEN found END AS text,
    CASE WHEN failed IS NOT NULL THEN 'FETCH_FAILED' WHEN blank THEN 'WEAK_EXTRACTION' END AS code, CASE WHEN failed IS NOT NULL THEN 'Firecrawl scrape failed: ' || failed WHEN blank THEN 'Firecrawl did not return useful page text.' END AS message,
    failed IS NULL AND NOT blank AND length(found) >= 4000 AS truncated FROM g"""
ORACLE_SQL["reader_resolve"] = f"""WITH {HTML}, st AS (SELECT page_id, url, content_type, {STATUS} AS status FROM h), u AS ({parsed('SELECT * FROM st')}), s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS seg FROM u)
  SELECT page_id, CASE WHEN fh = 'github.com' AND (len(seg) = 2 OR (len(seg) >= 5 AND seg[3] = 'blob') OR (len(seg) >= 4 AND seg[3] IN ('issues', 'pull'))) THEN 'github' WHEN h IS NOT NULL AND lp LIKE '%.pdf' THEN 'pdf'
    WHEN h = 'youtube.com' AND p = '/watch' AND regexp_matches(q, '[?&]v=[^&]') THEN 'youtube' WHEN NOT regexp_matches(url, '^https?://') THEN 'unsupported' WHEN status = 'unsupported' AND contains(lower(content_type), 'application/pdf') THEN 'pdf' ELSE 'http' END AS reader FROM s"""
ORACLE_SQL["fanout_passes"] = f"""WITH serp AS ({SERP}), g AS (SELECT query_id, floor(rank % 8 / 2) AS pass, provider, provider_pos, bool_or({GOOD} AND (rank + provider_pos) % 3 <> 0) AS good FROM serp GROUP BY ALL),
  n AS (SELECT query_id, provider, provider_pos, min(pass) FILTER (good) AS used, min(pass) FILTER (NOT good) AS missed FROM g GROUP BY ALL)
  SELECT query_id, coalesce(string_agg(provider, ',' ORDER BY used, provider_pos) FILTER (used IS NOT NULL), '') AS providers, coalesce(string_agg(provider, ',' ORDER BY missed, provider_pos) FILTER (used IS NULL), '') AS skipped FROM n GROUP BY 1"""
ORACLE_SQL["failure_code"] = f"SELECT conv_id, CASE WHEN regexp_matches(lower(message), 'blocked|rate limit|rate-limit|403|429|captcha|challenge') THEN 'BLOCKED' ELSE 'FETCH_FAILED' END AS code FROM ({I.oracle(Q._MESSAGES)}) m"
ORACLE_SQL["tool_call_times"] = f"""WITH RECURSIVE c AS ({I.oracle(I.CALLS)}),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY pos, phase = 'end', ms) AS k FROM c),
  r AS (SELECT session_id, tool_name, 0::BIGINT AS k, []::BIGINT[] AS open, NULL::BIGINT AS closes, NULL::BIGINT AS ended, NULL::BOOLEAN AS failed FROM (SELECT DISTINCT session_id, tool_name FROM c)
    UNION ALL SELECT o.session_id, o.tool_name, o.k, CASE WHEN phase = 'start' THEN list_append(open, o.k) ELSE open[:-2] END, CASE WHEN phase = 'end' THEN open[-1] END, o.ms, o.failed
    FROM r JOIN o ON o.session_id = r.session_id AND o.tool_name = r.tool_name AND o.k = r.k + 1)
  SELECT o.session_id, o.tool_name, o.pos, o.ms AS started, e.ended, e.ended - o.ms AS took_ms, e.failed FROM o LEFT JOIN (SELECT * FROM r WHERE closes IS NOT NULL) e
    ON e.session_id = o.session_id AND e.tool_name = o.tool_name AND e.closes = o.k WHERE o.phase = 'start'"""


_FORM = "replace(replace(replace(url_encode(q), '%20', '+'), '~', '%7E'), '%2A', '*')"
ORACLE_SQL["provider_search"] = f"""WITH a0 AS ({I.oracle(Q._ASKED)}), r AS ({I.oracle(Q._ANSWERED)}),
  a AS (SELECT *, {trim("coalesce(query, '')")} AS q, CASE provider WHEN 'brave' THEN 'Brave' WHEN 'exa' THEN 'Exa' WHEN 'tavily' THEN 'Tavily' WHEN 'youcom' THEN 'You.com' ELSE 'SearXNG' END AS name FROM a0),
  b AS (SELECT *, CASE WHEN q = '' THEN 'Query must not be empty.' WHEN provider = 'searxng' AND base_url IS NULL THEN 'SearXNG search provider requires backends.search.baseUrl'
      WHEN provider <> 'searxng' AND NOT has_key THEN name || ' search requires ' || CASE provider WHEN 'brave' THEN 'PI_WEB_AGENT_BRAVE_API_KEY' WHEN 'exa' THEN 'EXA_API_KEY' WHEN 'tavily' THEN 'TAVILY_API_KEY' ELSE 'YDC_API_KEY' END || '.' END AS bad FROM a),
  s AS (SELECT b.*, CASE WHEN bad IS NULL THEN CASE provider WHEN 'searxng' THEN (CASE request_id % 3 WHEN 0 THEN 'http://s.example' ELSE 'https://S.example:8080' END) || '/search?q=' || {_FORM} || '&format=json' || CASE WHEN categories IS NULL THEN '' ELSE '&categories=news%2Cit' END || coalesce('&language=' || language, '') || coalesce('&safesearch=' || level, '')
      WHEN 'brave' THEN 'https://api.search.brave.com/res/v1/web/search?q=' || {_FORM} WHEN 'exa' THEN 'https://api.exa.ai/search' WHEN 'tavily' THEN 'https://api.tavily.com/search' ELSE 'https://api.you.com/v1/agents/search' END END AS request_url,
    CASE WHEN bad IS NULL AND provider IN ('exa', 'tavily', 'youcom') THEN '{{"query":' || to_json(q)::VARCHAR || ',"' || CASE provider WHEN 'exa' THEN 'numResults' ELSE 'max_results' END || '":10}}' END AS request_body,
    http_status, failure, CASE WHEN json_valid(body) THEN body END AS j FROM b LEFT JOIN r USING (request_id, provider)),
  h AS (SELECT *, coalesce(list_filter(CAST(coalesce(json_extract(j, '$.web.results'), json_extract(j, '$.results')) AS JSON[]), lambda x: json_type(x, '$.title') = 'VARCHAR' AND json_type(x, '$.url') = 'VARCHAR'), []) AS hits,
    CASE WHEN bad IS NULL THEN coalesce(failure, CASE WHEN http_status IS NULL THEN 'no answer' WHEN http_status <> 200 THEN 'HTTP ' || http_status WHEN j IS NULL THEN 'invalid JSON' END) END AS wrong FROM s),
  k AS (SELECT *, CASE WHEN bad IS NOT NULL THEN CASE WHEN q = '' THEN 'INVALID_QUERY' ELSE 'BACKEND_CONFIG_INVALID' END WHEN wrong IS NOT NULL THEN 'FETCH_FAILED' WHEN len(hits) = 0 THEN 'NO_RESULTS' END AS code FROM h)
  SELECT request_id, provider, CASE WHEN bad IS NULL THEN CASE WHEN provider IN ('searxng', 'brave') THEN 'GET' ELSE 'POST' END END AS method, request_url, request_body,
    CASE WHEN bad IS NULL THEN CASE provider WHEN 'brave' THEN 'X-Subscription-Token' WHEN 'exa' THEN 'x-api-key' WHEN 'tavily' THEN 'Authorization' WHEN 'youcom' THEN 'X-API-Key' END END AS key_header,
    CASE WHEN code IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN code IS NULL THEN len(hits) ELSE 0 END::INTEGER AS n, CASE WHEN code IS NULL THEN json_extract_string(hits[1], '$.title') END AS title, CASE WHEN code IS NULL THEN json_extract_string(hits[1], '$.url') END AS url,
    CASE WHEN code IS NULL THEN coalesce(json_extract_string(hits[1], '$.description'), json_extract_string(hits[1], '$.text'), json_extract_string(hits[1], '$.snippet'), json_extract_string(hits[1], '$.content')) END AS snippet, code,
    coalesce(bad, CASE WHEN wrong IS NOT NULL THEN name || ' search request failed: ' || wrong WHEN len(hits) = 0 THEN name || ' returned no usable results for this query.' END) AS message FROM k"""
ORACLE_SQL["backend_sets"] = f"""WITH x AS ({ORACLE_SQL["config_merge"]}), y AS (SELECT *, coalesce(fanout_mode, 'off') <> 'off' AS fans,
    list_filter([provider] || string_split(coalesce(nullif(fanout_providers, ''), usable), ',') || CASE WHEN fallback = 'duckduckgo' THEN ['duckduckgo'] ELSE [] END, lambda p: true) AS l FROM x)
  SELECT config_id, CASE WHEN fans THEN 'fanout ' || fanout_mode WHEN provider <> 'duckduckgo' AND fallback = 'duckduckgo' THEN 'fallback' ELSE 'single' END AS mode,
    CASE WHEN fans THEN array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), ',') ELSE provider END AS providers,
    CASE WHEN NOT fans AND provider <> 'duckduckgo' AND fallback = 'duckduckgo' THEN fallback END AS fallback FROM y"""
_LACKS = """CASE NAME WHEN 'searxng' THEN CASE WHEN coalesce(base_url, '') = '' THEN 'missing baseUrl' END WHEN 'brave' THEN CASE WHEN trim(coalesce(brave_key, '')) = '' THEN 'missing PI_WEB_AGENT_BRAVE_API_KEY' END
  WHEN 'exa' THEN CASE WHEN trim(coalesce(exa_key, '')) = '' THEN 'missing EXA_API_KEY' END WHEN 'youcom' THEN 'missing YDC_API_KEY' WHEN 'tavily' THEN 'missing TAVILY_API_KEY' END"""
ORACLE_SQL["health_report"] = f"""WITH x AS ({ORACLE_SQL["config_merge"]}), k AS (SELECT config_id, brave_key, exa_key FROM ({I.oracle(I.CONFIGS)}) q), p AS ({I.oracle(Q._PROBES)}),
  a AS (SELECT x.*, brave_key, exa_key, http_status, CASE WHEN ms > 3000 THEN 'This operation was aborted' ELSE failure END AS wrong, CASE WHEN json_valid(body) THEN body END AS j FROM x JOIN k USING (config_id) JOIN p USING (config_id)),
  b AS (SELECT *, coalesce({_LACKS.replace("NAME", "provider")}, wrong, CASE WHEN http_status <> 200 AND provider <> 'searxng' THEN 'HTTP ' || http_status END, CASE WHEN j IS NULL THEN 'invalid JSON' END,
      CASE WHEN http_status <> 200 OR coalesce(json_type(j, CASE WHEN provider = 'brave' THEN '$.web.results' ELSE '$.results' END), '') <> 'ARRAY' THEN 'unexpected response' END) AS why,
    coalesce(CASE WHEN coalesce(fetch_base_url, '') = '' THEN 'missing baseUrl' END, wrong, CASE WHEN http_status <> 200 THEN 'HTTP ' || http_status END) AS bad,
    string_split(coalesce(fanout_providers, 'duckduckgo,searxng,brave,youcom,exa,tavily'), ',') AS asked FROM a)
  SELECT config_id, concat_ws(chr(10), 'search backend: ' || provider || CASE WHEN provider = 'duckduckgo' THEN '' WHEN why IS NULL THEN ' ok' ELSE ' warning (' || why || ')' END, 'search fallback: ' || fallback,
    CASE WHEN fanout_mode <> 'off' THEN 'search fanout: ' || fanout_mode || ' (' || array_to_string(asked, ', ') || ')' END,
    CASE WHEN fanout_mode <> 'off' THEN nullif(array_to_string(list_filter(list_transform(asked, lambda n: 'search fanout provider ' || n || ' warning (' || ({_LACKS.replace("NAME", "n")}) || ')'), lambda l: l IS NOT NULL), chr(10)), '') END,
    'fetch backend: ' || CASE WHEN fetch_provider = 'http' THEN 'http' WHEN bad IS NULL THEN 'firecrawl ok' ELSE 'firecrawl warning (' || bad || ')' END, 'fetch fallback: ' || fetch_fallback,
    'headless backend: local-browser (managed Chromium fallback configured)') AS report FROM b"""
ORACLE_SQL["config_runs"] = f"""WITH x AS ({ORACLE_SQL["config_merge"]}), c AS (SELECT c_custkey AS id, c_custkey // 50 AS session_id, min(c_custkey) OVER (PARTITION BY c_custkey // 50, c_custkey // 3) AS source FROM customer),
  k AS (SELECT session_id, id, concat_ws('|', provider, coalesce(base_url, '-'), coalesce(x.fallback, '-'), coalesce(categories, '-'), coalesce(language, '-'), coalesce(safesearch::VARCHAR, '-'), coalesce(fanout_mode, '-'), coalesce(fanout_providers, '-'), fetch_provider,
    coalesce(fetch_base_url, '-'), coalesce(api_key, '-'), coalesce(fetch_fallback, '-'), coalesce(formats, '-'), coalesce(only_main::VARCHAR, '-')) AS said FROM c JOIN x ON x.config_id = c.source),
  f AS (SELECT *, CASE WHEN lag(said) OVER (PARTITION BY session_id ORDER BY id) IS DISTINCT FROM said THEN 1 ELSE 0 END AS begins FROM k),
  n AS (SELECT *, sum(begins) OVER (PARTITION BY session_id ORDER BY id) - 1 AS run FROM f)
  SELECT session_id, run::BIGINT AS run, min(id) AS first_pos, max(id) AS last_pos, count(*) AS uses FROM n GROUP BY 1, 2"""
ORACLE_SQL["config_status"] = f"""WITH b AS ({I.oracle(Q._BODIES)}), v AS (SELECT config_id, body, CASE WHEN json_valid(body) AND json_type(body) <> 'NULL' THEN body END AS j FROM b),
  r AS (SELECT *, coalesce(list_contains(CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END, 'presentation'), false) AS rooted FROM v),
  p AS (SELECT *, CASE WHEN rooted THEN '$.presentation' ELSE '$' END AS root FROM r)
  SELECT config_id, CASE WHEN body IS NULL THEN 'missing' WHEN j IS NULL THEN 'malformed' WHEN rooted THEN 'ok' ELSE 'legacy' END AS status,
    CASE WHEN rooted THEN json_extract_string(j, '$.presentation.defaultMode') ELSE json_extract_string(j, '$.defaultMode') END AS default_mode,
    CASE WHEN rooted THEN json_extract_string(j, '$.presentation.tools.web_search.mode') ELSE json_extract_string(j, '$.tools.web_search.mode') END AS search_mode FROM p"""
ORACLE_SQL["config_store"] = f"""WITH w AS ({I.oracle(Q._WRITES)}), z AS (SELECT key, max(version) FILTER (kind = 'reset') AS reset FROM w GROUP BY 1),
  l AS (SELECT w.* FROM w JOIN z USING (key) WHERE z.reset IS NULL OR w.version > z.reset),
  s AS (SELECT key, max(version) AS version, arg_max(body, version) FILTER (kind = 'presentation') AS p, arg_max(body, version) FILTER (kind = 'backends') AS b, arg_max(body, version) FILTER (kind = 'seen') AS seen FROM l GROUP BY 1)
  SELECT key, version, json_extract_string(p, '$.defaultMode') AS default_mode, json_extract_string(b, '$.search.provider') AS provider, json_extract_string(b, '$.fetch.baseUrl') AS base_url, NULL AS api_key, json_extract_string(seen, '$.lastChangelogVersion') AS seen FROM s"""


def _parts(version: str) -> str:
    return f"list_transform(string_split({version}, '.'), lambda x: x::INTEGER)"


ORACLE_SQL["update_notice"] = f"""WITH v AS (SELECT *, row_number() OVER () AS r FROM ({ORACLE_SQL['changelog_sections']}) x), i AS ({I.oracle(Q._INSTALLED)}),
  o AS (SELECT log_id, version, content, CASE WHEN content LIKE '## [1.%' THEN 1 WHEN content LIKE '## 0.9%' THEN 2 END AS place FROM v)
  SELECT i.log_id, string_agg(content, chr(10) || chr(10) ORDER BY place) FILTER (i.seen IS NOT NULL AND {_parts('i.version')} > {_parts('i.seen')} AND {_parts('o.version')} > {_parts('i.seen')}) AS notice, arg_min(content, place) AS latest FROM i LEFT JOIN o USING (log_id) GROUP BY 1"""

# --- evidence and views ---------------------------------------------------------------------------------------------

_SENTENCES = """CASE r WHEN 'community-only' THEN 'the strongest readable sources were mostly community/practical context' WHEN 'low-diversity' THEN 'the source set was narrow'
  WHEN 'unreadable-direct-source' THEN 'one or more linked sources could not be read reliably' WHEN 'unreadable-thread-source' THEN 'one or more thread sources could not be read reliably'
  WHEN 'possible-conflict' THEN 'readable sources include cautionary or possibly conflicting guidance' ELSE 'some candidate sources showed bot-check or security verification pages' END"""
ORACLE_SQL["evidence_quality"] = rf"""{WITH_URLS}, {_EVIDENCE}, f AS (SELECT query_id, count(*) AS total, count(*) FILTER (source_kind IN ('official-docs', 'official-api')) AS official, count(*) FILTER (source_kind = 'community') AS community,
    count(*) FILTER (source_kind = 'issue-thread') AS thread, count(DISTINCT coalesce(h, lower(url))) AS distinct_hosts, count(*) FILTER (source_kind = 'official-docs') AS docs, count(*) FILTER (source_kind = 'official-api') AS api,
    bool_or(regexp_matches(summary, '\bdeprecated\b|not recommended|use at your own risk|should not')) AND bool_or(regexp_matches(replace(summary, 'not recommended', ''), '\brecommended\b')) AS conflict FROM ranked GROUP BY 1),
  g AS (SELECT *, official AS strong, official = 0 AS only_community, total > 1 AND distinct_hosts <= 1 AS low_diversity, query_id % 4 = 0 AND query_id % 8 <> 0 AS direct, query_id % 8 = 0 AS threads, query_id % 5 = 0 AS bot FROM f),
  k AS (SELECT *, list_filter([CASE WHEN only_community THEN 'community-only' END, CASE WHEN low_diversity THEN 'low-diversity' END, CASE WHEN direct THEN 'unreadable-direct-source' END, CASE WHEN threads THEN 'unreadable-thread-source' END,
    CASE WHEN conflict THEN 'possible-conflict' END, CASE WHEN bot THEN 'bot-check' END], lambda x: x IS NOT NULL) AS rs FROM g),
  c AS (SELECT *, list_transform(rs, lambda r: {_SENTENCES}) AS said, docs > 0 AND api > 0 AS two FROM k)
  SELECT query_id, total, official, community, thread, distinct_hosts, strong, only_community, low_diversity, conflict, array_to_string(rs, ',') AS reasons,
    CASE WHEN strong >= 2 AND (only_community OR (low_diversity AND NOT two)) THEN 'search-again' WHEN strong >= 2 AND len(list_filter(rs, lambda x: NOT (two AND x = 'low-diversity'))) > 0 THEN 'answer-with-caveat' WHEN strong >= 2 THEN 'answer'
      WHEN query_id % 3 = 0 THEN 'headless' ELSE 'search-again' END AS next_step,
    CASE WHEN len(said) = 0 THEN 'Evidence is partial, so this answer is based on the strongest source found within the bounded research budget.'
      WHEN len(said) = 1 THEN 'Evidence is partial: ' || said[1] || '.' ELSE 'Evidence is partial: ' || array_to_string(said[:-2], ', ') || ', and ' || said[-1] || '.' END AS caveat FROM c"""


def _short(x: str, n: int) -> str:
    return f"CASE WHEN {x} = '' THEN NULL WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n}), '{WS}+$', '') || '…' END"


_PREVIEW = trim(f"title || chr(10) || coalesce({_short('text', 240)}, '')")
ORACLE_SQL["fetch_views"] = f"""WITH {HTML}, s AS (SELECT *, {STATUS} AS status FROM h)
  SELECT page_id, CASE status WHEN 'ok' THEN 'Fetched page · article extracted' || CASE WHEN {collapse('text')} <> '' THEN ' · ' || len(string_split({collapse('text')}, ' ')) || ' words' ELSE '' END
      WHEN 'needs_headless' THEN 'Needs headless rendering: Headless rendering recommended.' ELSE 'Fetch failed: Unknown fetch failure.' END AS compact,
    CASE WHEN title <> '' THEN {_PREVIEW} ELSE {_short('text', 240)} END AS preview,
    CASE WHEN status = 'ok' THEN concat_ws(chr(10), 'URL: ' || url, 'Title: ' || title, {_short('text', 500)}) END AS verbose FROM s"""
ORACLE_SQL["search_views"] = f"""WITH f AS ({ORACLE_SQL['fanout_merge']}), p AS ({ORACLE_SQL['fanout_providers']}),
  v AS (SELECT query_id, count(*) AS n, string_agg((pos + 1) || '. ' || title, chr(10) ORDER BY pos) FILTER (pos < 3) AS preview, string_agg((pos + 1) || '. ' || title || chr(10) || '   ' || url || chr(10) || '   ' || snippet, chr(10) ORDER BY pos) FILTER (pos < 5) AS verbose FROM f GROUP BY 1),
  t AS (SELECT p.*, coalesce(n, 0) AS n, preview, v.verbose AS listing, CASE WHEN query_id % 5 = 0 THEN 'searxng failed; used duckduckgo fallback. ' ELSE '' END AS prefix,
    CASE WHEN providers <> '' THEN ' (fanout: ' || replace(providers, ',', ', ') || CASE WHEN skipped <> '' THEN '; skipped: ' || replace(skipped, ',', ', ') ELSE '' END || ')' WHEN skipped <> '' THEN ' (fanout; skipped: ' || replace(skipped, ',', ', ') || ')' ELSE '' END AS note FROM p LEFT JOIN v USING (query_id))
  SELECT query_id, prefix || CASE WHEN n = 0 THEN 'Search failed: Unknown search failure.' ELSE 'Found ' || n || CASE WHEN n = 1 THEN ' result' ELSE ' results' END END || note AS compact, preview, listing AS verbose FROM t"""

# --- the composed search and read, settings, releases and reports ---------------------------------------------------

ORACLE_SQL["search_tool"] = f"""WITH RECURSIVE q AS (SELECT request_id, {trim('query')} AS key, epoch_ms(ts) AS ms FROM ({I.oracle(Q._REQUESTS)}) x),
  s AS (SELECT query AS key, html, failure, nullif(regexp_extract(html, 'class="result__a" href="[^"]+">([^<]*)<', 1), '') AS title FROM ({I.oracle(Q._ANSWERS)}) y),
  j AS (SELECT request_id, q.key, ms, failure, title, CASE WHEN q.key = '' THEN 'INVALID_QUERY' WHEN html IS NULL AND regexp_matches(failure, '429') THEN 'BLOCKED' WHEN html IS NULL THEN 'FETCH_FAILED' WHEN title IS NOT NULL THEN 'ok'
    WHEN contains(lower(html), 'no results found') THEN 'NO_RESULTS' WHEN contains(lower(html), 'captcha') THEN 'BLOCKED' ELSE 'PARSE_FAILED' END AS code FROM q LEFT JOIN s ON q.key = s.key),
  a AS (SELECT request_id, key, ms, row_number() OVER (PARTITION BY key ORDER BY ms, request_id) AS i FROM j WHERE code = 'ok' AND ms IS NOT NULL),
  r AS (SELECT key, request_id, i, false AS hit, ms + {Q.TTL_MS} AS expires FROM a WHERE i = 1
    UNION ALL SELECT a.key, a.request_id, a.i, r.expires > a.ms, CASE WHEN r.expires > a.ms THEN r.expires ELSE a.ms + {Q.TTL_MS} END FROM r JOIN a ON a.key = r.key AND a.i = r.i + 1)
  SELECT j.request_id, CASE WHEN code = 'ok' THEN 'ok' ELSE 'error' END AS status, nullif(code, 'ok') AS code, coalesce(hit, false) AS cache_hit, title,
    CASE code WHEN 'INVALID_QUERY' THEN 'Query must not be empty.' WHEN 'NO_RESULTS' THEN 'DuckDuckGo returned no usable results for this query.' WHEN 'BLOCKED' THEN 'DuckDuckGo search appears to be blocked or rate limited.'
      WHEN 'PARSE_FAILED' THEN 'DuckDuckGo returned a page, but it did not match the expected results format.' WHEN 'FETCH_FAILED' THEN 'DuckDuckGo search request failed: ' || coalesce(failure, 'Unknown search failure.') END AS message
  FROM j LEFT JOIN r ON r.request_id = j.request_id"""
_RAW = f"SELECT page_id, {trim('url')} || CASE WHEN page_id % 3 = 0 THEN '#part/' ELSE '' END AS url FROM ({I.oracle(I.URLS)}) x"
ORACLE_SQL["settings_url"] = f"""WITH u AS ({parsed(_RAW)}) SELECT page_id, fh IS NOT NULL AS ok, CASE WHEN fh IS NOT NULL THEN regexp_replace(scheme || '://' || fh || CASE WHEN port = '' OR port = CASE WHEN scheme = 'https' THEN '443' ELSE '80' END THEN '' ELSE ':' || port END || p || q || {part(6)}, '/$', '') END AS value,
  CASE WHEN fh IS NULL THEN 'Invalid URL. Include http:// or https://.' END AS message FROM u"""
_READS = Q._READS.replace("{urls}", f"({I.oracle(I.URLS)}) u")
ORACLE_SQL["repo_read"] = f"""WITH t AS ({ORACLE_SQL['reader_route']}), r AS (SELECT r.*, shape, raw_url, CASE WHEN shape IS NULL THEN 'Unsupported GitHub URL shape for the reader.' WHEN failure IS NOT NULL THEN failure WHEN http_status IS NULL THEN 'GitHub read failed.'
    WHEN http_status <> 200 THEN CASE WHEN raw_url IS NULL THEN 'GitHub API returned ' ELSE 'GitHub returned ' END || http_status || ' for ' || coalesce(raw_url, 'https://api.github.com/x') END AS message FROM ({_READS}) r JOIN t USING (page_id))
  SELECT page_id, CASE WHEN message IS NULL THEN 'ok' ELSE 'error' END AS status, url, CASE WHEN message IS NULL THEN 'T' || page_id END AS title, CASE WHEN message IS NULL THEN substr(repeat('word ', (page_id % 6000)::BIGINT), 1, 24000) END AS text,
    message IS NULL AND page_id % 6000 * 5 >= 24000 AS truncated, CASE WHEN message IS NOT NULL THEN 'GITHUB_FETCH_FAILED' END AS code, message FROM r"""


def _own(tool: str) -> str:
    return f"CASE WHEN {{x}} IN ('compact', 'preview', 'verbose') THEN {{x}} END".replace("{x}", f"json_extract_string({{f}}, '$.presentation.tools.{tool}.mode')")


def _said_mode(field: str, none: str) -> str:
    return "coalesce(" + ", ".join(field.replace("{f}", f"CASE WHEN json_valid({f}) THEN {f} END") for f in ("project", "own")) + f", '{none}')"


_DEFAULT = "CASE WHEN json_extract_string({f}, '$.presentation.defaultMode') IN ('compact', 'preview', 'verbose') THEN json_extract_string({f}, '$.presentation.defaultMode') END"
_TOOL_LINES = " || chr(10) || ".join(f"'{t}: ' || {_said_mode(_own(t), 'inherit')}" for t in ("web_explore", "web_search", "web_fetch", "web_fetch_headless"))
ORACLE_SQL["config_summary"] = f"""WITH m AS ({ORACLE_SQL['config_merge']}), c AS ({I.oracle(I.CONFIGS)})
  SELECT config_id, concat_ws(chr(10), concat_ws(' ', 'search: ' || provider, '(' || nullif(base_url, '') || ')', 'fallback ' || fallback, 'categories ' || nullif(categories, ''), 'language ' || nullif(language, ''), 'safesearch ' || safesearch,
      CASE WHEN fanout_mode <> 'off' THEN 'fanout ' || fanout_mode || ' (' || replace(coalesce(fanout_providers, usable), ',', ', ') || ')' END),
    concat_ws(' ', 'fetch: ' || fetch_provider, '(' || nullif(fetch_base_url, '') || ')', 'fallback ' || fetch_fallback, 'formats ' || nullif(formats, ''), 'onlyMainContent ' || only_main), 'headless: local-browser') AS backends,
    'defaultMode: ' || {_said_mode(_DEFAULT, 'compact')} || chr(10) || {_TOOL_LINES} AS presentation FROM m JOIN c USING (config_id)"""
ORACLE_SQL["release_texts"] = rf"""WITH c AS ({I.oracle(Q._RELEASES)}), b AS (SELECT *, regexp_extract(content, '## Unreleased\s*((?:.|\n)*?)(?:\n## \[|\z)', 1) AS body FROM c),
  l AS (SELECT doc_id, generate_subscripts(string_split_regex(body, '\r?\n'), 1) AS i, unnest(string_split_regex(body, '\r?\n')) AS raw FROM b WHERE contains(content, '## Unreleased')),
  t AS (SELECT doc_id, i, {trim('raw')} AS line FROM l), h AS (SELECT *, nullif(regexp_extract(line, '^###\s+(Added|Changed|Fixed|Breaking)$', 1), '') AS head FROM t),
  p AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS part, {trim(r"regexp_replace(line, '^-\s*', '')")} AS entry FROM h),
  e AS (SELECT doc_id, count(*) AS n, string_agg(part || ': ' || entry, '|' ORDER BY i) AS entries, bool_or(part = 'Breaking') AS breaks, bool_or(part = 'Added') AS adds FROM p WHERE head IS NULL AND part IS NOT NULL AND starts_with(line, '-') AND entry NOT IN ('', 'None.') GROUP BY 1),
  g AS (SELECT b.*, contains(content, '## Unreleased') AS has, n, entries, CASE WHEN breaks THEN 'major' WHEN adds THEN 'minor' ELSE 'patch' END AS b2, string_split(content, '## [' || regexp_replace(tag, '^v', '') || ']') AS cut FROM b LEFT JOIN e USING (doc_id))
  SELECT doc_id, CASE WHEN has THEN coalesce(n, 0) END AS n_entries, CASE WHEN has THEN coalesce(entries, '') END AS entries, CASE WHEN has THEN b2 END AS bump,
    CASE WHEN has THEN CASE b2 WHEN 'major' THEN '2.0.0' WHEN 'minor' THEN '1.' || (doc_id % 20 + 1) || '.0' ELSE '1.' || (doc_id % 20) || '.4' END END AS next_version,
    CASE WHEN len(cut) > 1 THEN {trim(r"regexp_extract(cut[2], '^[^\n]*\n((?:.|\n)*?)(?:\n## \[|\z)', 1)")} END AS notes FROM g"""
ORACLE_SQL["message_texts"] = """SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 2 THEN CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || chr(10) || text END WHEN 4 THEN CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || chr(10) END || 'end'
  WHEN 5 THEN '' WHEN 6 THEN '' ELSE coalesce(text, '') END AS said FROM conversations"""
_ISO = "strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ')"
ORACLE_SQL["evaluation_report"] = f"""WITH v AS ({ORACLE_SQL['tool_call_verdict']}), s AS (SELECT user_id AS session_id, {_ISO} AS started FROM events GROUP BY 1),
  o AS (SELECT session_id, string_agg('  ' || k || '. ' || tool_name, chr(10) ORDER BY k) AS tools FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS k FROM ({I.oracle(I.LOG)}) l) n GROUP BY 1)
  SELECT v.session_id, started, replace(replace(started, ':', '-'), '.', '-') AS stamp, concat('## Session ', v.session_id, '

Prompt: session ', v.session_id, '

Verdict: **', verdict, '**

Metrics:
- web_explore used: ', explore_used, '
- web_explore first web tool: ', explore_first,
    '
- total tool calls: ', tool_calls, '
- total web tool calls: ', web_calls, '
- network shell fallbacks after web_explore: ', shell_after, '
Tool order:
', tools, '

Notes:
- ', CASE WHEN notes = '' THEN 'none' ELSE replace(notes, ',', '
- ') END,
    '

Final answer:

', CASE WHEN v.session_id % 9 = 0 THEN '(empty)' ELSE 'done' END, '
') AS section FROM v JOIN s USING (session_id) JOIN o USING (session_id)"""
ORACLE_SQL["failure_report"] = f"""WITH f AS ({ORACLE_SQL['failure_code']}), m AS ({I.oracle(Q._MESSAGES)}),
  j AS (SELECT conv_id, CASE WHEN conv_id % 6 < 4 THEN 'BLOCKED' ELSE 'FETCH_FAILED' END AS hoped, code, 'DuckDuckGo search appears to be blocked or rate limited.' AS wanted, CASE WHEN code = 'BLOCKED' THEN 'DuckDuckGo search appears to be blocked or rate limited.' ELSE 'DuckDuckGo search request failed: ' || message END AS said FROM f JOIN m USING (conv_id)),
  n AS (SELECT *, concat_ws('
- ', CASE WHEN hoped <> code THEN 'expected code ' || hoped || ' but got ' || code END, CASE WHEN wanted <> said THEN 'expected message "' || wanted || '" but got "' || said || '"' END) AS notes FROM j)
  SELECT conv_id, CASE WHEN notes = '' THEN 'pass' ELSE 'fail' END AS verdict, '### case ' || conv_id || '

Verdict: **' || CASE WHEN notes = '' THEN 'pass' ELSE 'fail' END || '**

- expected code: ' || hoped || '
- actual code: ' || code || '
- expected message: ' || wanted
    || '
- actual message: ' || said || '

Notes:
- ' || CASE WHEN notes = '' THEN 'none' ELSE notes END || '
' AS section FROM n"""
_COUNTED = "'\"cases\":' || coalesce(NAME.n, 0) || ',\"pass\":' || coalesce(NAME.ok, 0) || ',\"mixed\":' || coalesce(NAME.mixed, 0) || ',\"fail\":' || coalesce(NAME.bad, 0)"
_COUNTS = "count(*) AS n, count(*) FILTER (verdict = 'pass') AS ok, count(*) FILTER (verdict = 'mixed') AS mixed, count(*) FILTER (verdict = 'fail') AS bad"
ORACLE_SQL["evaluation_runs"] = f"""WITH e AS ({ORACLE_SQL["evaluation_report"]}), w AS ({ORACLE_SQL["tool_call_verdict"]}), g AS ({ORACLE_SQL["failure_report"]}),
  s AS (SELECT session_id // 5 AS run_id, min(started) AS started, max(started) AS finished, string_agg(section, chr(10) || '---' || chr(10) || chr(10) ORDER BY session_id) AS said, {_COUNTS} FROM e JOIN w USING (session_id) GROUP BY 1),
  f AS (SELECT conv_id // 500 AS run_id, string_agg(section, chr(10) ORDER BY conv_id) AS said, {_COUNTS} FROM g WHERE conv_id % 3 = 0 GROUP BY 1)
  SELECT run_id, replace(replace(started, ':', '-'), '.', '-') AS stamp, concat('# live web eval', chr(10), chr(10), 'Started: ', started, chr(10), 'Finished: ', finished, chr(10), 'CWD: /runs/', run_id, chr(10), chr(10), s.said, chr(10), chr(10), '---', chr(10), chr(10),
    '## Search failure cases', chr(10), chr(10), coalesce(f.said, 'None.' || chr(10)), chr(10)) AS markdown,
    '{{"startedAt":"' || started || '","finishedAt":"' || finished || '","cwd":"/runs/' || run_id || '","prompts":{{' || {_COUNTED.replace("NAME", "s")} || '}},"searchFailureCases":{{' || {_COUNTED.replace("NAME", "f")} || '}}}}' AS json FROM s LEFT JOIN f USING (run_id)"""
