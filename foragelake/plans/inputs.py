"""Inputs of the queries, derived from the given tables by SQL that Spark and DuckDB both read.

Every page, URL and first turn is read whole, as it is. The crawled pages have neither documentation hosts nor script
shells, and no search results come with them; so rows with ids of their own (from EXTRA on) are added, in which a rule on
the row number reaches every branch of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ids of added rows are those of the rows they come from plus this.
EXTRA = 1_000_000_000_000

URLS = f"""SELECT page_id, url FROM {{pages}}
UNION ALL SELECT page_id + {EXTRA} AS page_id, CASE page_id % 16
  WHEN 1 THEN concat('https://playwright.dev/docs/api/p', page_id)
  WHEN 2 THEN concat('https://www.playwright.dev/docs/intro?utm_source=x&b=', page_id, '#frag')
  WHEN 3 THEN 'https://vitest.dev/config/'
  WHEN 4 THEN concat('https://vitest.dev/guide/g', page_id, '/')
  WHEN 5 THEN concat('https://github.com/vitest-dev/vitest/blob/main/docs/a%20b/p', page_id, '.md')
  WHEN 6 THEN concat('https://github.com/o/r/issues/', page_id)
  WHEN 7 THEN concat('https://www.reddit.com/r/x/comments/', page_id, '?GCLID=1')
  WHEN 8 THEN concat('https://stackoverflow.com/questions/', page_id)
  WHEN 9 THEN concat('https://community.example.org:443/t/topic', page_id)
  WHEN 10 THEN concat('http://npmjs.com:80/package/p', page_id)
  WHEN 11 THEN 'HTTPS://WWW.Example.com/A%20b?fbclid=2'
  WHEN 12 THEN CASE WHEN page_id % 32 = 12 THEN concat('not a url ', page_id) ELSE concat('  http:', chr(92), chr(92), 'Odd.example.com:0080', chr(92), 'é p', page_id, chr(92), '`x`?q=', chr(39), 'ü ', page_id) END
  WHEN 13 THEN concat('https://learn.microsoft.com/en-us/p', page_id, '.pdf')
  WHEN 14 THEN concat('https://www.youtube.com/watch?v=v', page_id, '&t=3')
  ELSE concat('https://github.com/o/r', page_id) END AS url
FROM {{pages}} WHERE page_id % 16 <> 0"""

HTML = f"""SELECT page_id, url, html, 'text/html; charset=utf-8' AS content_type FROM {{pages}}
UNION ALL SELECT page_id + {EXTRA} AS page_id, url, CASE page_id % 7
  WHEN 0 THEN concat('<html><head><title>App &amp; more</title></head><body><script src="a.js"></script><div id="root"></div></body></html>')
  WHEN 1 THEN concat('<html><head><title>Just a moment...</title></head><body><main>Checking your browser before you go on to page ', page_id, '</main></body></html>')
  WHEN 2 THEN '<html><body>Please enable JavaScript to see what this short page has to say.</body></html>'
  WHEN 3 THEN '<html><body>Too short</body></html>'
  ELSE html END AS html,
  CASE WHEN page_id % 11 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type
FROM {{pages}} WHERE page_id % 16 <> 0"""

QUESTIONS = f"""SELECT conv_id AS query_id, text AS query FROM {{conversations}} WHERE turn = 0
UNION ALL SELECT conv_id + {EXTRA} AS query_id, CASE conv_id % 8
  WHEN 0 THEN concat('How to find the ', text, ' in vitest')
  WHEN 1 THEN concat('playwright  setup for ', text)
  WHEN 2 THEN concat('tell me  about edge ', conv_id, ' and reddit comments')
  WHEN 3 THEN concat('see https://example.com/a', conv_id, '?utm_medium=m&x=1), (http://www.example.org/b/). and find more')
  WHEN 4 THEN concat('Read https://github.com/o/r/issues/', conv_id + 2, ' please')
  WHEN 5 THEN '   '
  ELSE concat('current ', text, ' discussion') END AS query
FROM {{conversations}} WHERE turn = 0 AND conv_id % 8 <> 7"""

# All providers find every crawled page; of the added rows each provider leaves out some.
# All providers find every crawled page; of the added rows each provider leaves out some. A question has 40 pages.
SERP = f"""SELECT query_id, CAST(0 AS INT) AS step, v.provider AS provider, CAST(v.provider_pos AS INT) AS provider_pos,
  CAST(2 * (n % 40) + CASE WHEN page_id < {EXTRA} THEN 0 ELSE 1 END AS INT) AS rank, concat(v.provider, ' ', substr('title title title', 1, CAST(5 + (page_id * v.m) % 9 AS INT))) AS title,
  concat(url, CASE WHEN (page_id + v.m) % 3 = 0 THEN '/' ELSE '' END) AS url,
  substr('snippet text here', 1, CAST(3 + (page_id * v.m) % 11 AS INT)) AS snippet,
  CASE WHEN (query_id + v.m) % 9 = 0 THEN 'error' ELSE 'ok' END AS status,
  CAST(1000 + ((query_id % 40) * v.m * 777) % 9000 AS BIGINT) AS latency_ms
FROM (SELECT page_id, url, page_id % {EXTRA} AS n, CAST(floor((page_id % {EXTRA}) / 40) AS BIGINT) AS query_id FROM {{urls}}) p
CROSS JOIN (SELECT 'duckduckgo' AS provider, 0 AS provider_pos, 1 AS m UNION ALL SELECT 'brave', 1, 2 UNION ALL SELECT 'exa', 2, 5) v
WHERE page_id < {EXTRA} OR (page_id * v.m) % 5 <> 1"""

LOG = """SELECT user_id AS session_id, event_id AS pos, CASE CAST(event_id * 7 % 10 AS INT)
  WHEN 0 THEN 'web_explore' WHEN 1 THEN 'web_search' WHEN 2 THEN 'web_fetch' WHEN 3 THEN 'web_fetch_headless' WHEN 4 THEN 'read' ELSE 'bash' END AS tool_name,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'curl -s x' WHEN 1 THEN 'ls -la' WHEN 2 THEN 'npm  view a' WHEN 3 THEN 'cat http://a.b' WHEN 4 THEN 'mycurl x' ELSE NULL END AS command
FROM {events}"""



def _files(texts: list[str | None]) -> str:
    cases = "".join(f" WHEN {i} THEN '{t.replace('{', '{{').replace('}', '}}')}'" for i, t in enumerate(texts) if t is not None)
    return f"CASE c_custkey % {len(texts)}{cases} END"


_GLOBAL = [
    '{"backends":{"search":{"provider":"searxng","baseUrl":"http://s","options":{"categories":["a","b"],"language":"en","safesearch":1}}},"presentation":{"defaultMode":"preview","tools":{"web_search":{"mode":"verbose"},"web_fetch":{"mode":"loud"}}}}',
    '{"backends":{"search":{"provider":"brave","fallback":"duckduckgo"}},"presentation":{"defaultMode":5}}',
    '{"backends":{"search":{"fanout":{"mode":"auto","providers":["exa","searxng"]}}}}',
    "no json",
    '{"backends":{"search":{"provider":"bing"},"fetch":{"provider":"firecrawl","apiKey":"k","options":{"formats":[],"onlyMainContent":true}}}}',
    '{"backends":{"search":{"provider":"searxng","options":{"categories":[],"safesearch":"1","language":" "}}}}',
    None,
    '{"backends":{"search":{"provider":"tavily","baseUrl":"x","fanout":{"mode":"on","providers":["exa","bing"]}},"headless":{"provider":"local-browser"}},"presentation":{"tools":{"web_explore":null,"web_fetch":{"mode":"compact"}}}}',
]
_PROJECT = [
    None,
    '{"backends":{"search":{"provider":"searxng","options":{"language":"de"}}},"presentation":{"tools":{"web_search":{"mode":"compact"}}}}',
    '{"backends":{"fetch":{"provider":"http","fallback":"http"},"search":{"provider":"duckduckgo","fallback":"duckduckgo"}}}',
    '{"backends":{"search":{"fanout":{"mode":"off","providers":["searxng"]}},"fetch":{"provider":"firecrawl","baseUrl":"http://f","fallback":"http","options":{"formats":["markdown",3]}}},"presentation":{"defaultMode":"verbose"}}',
    '{"backends":{"search":{"fanout":{"mode":"sometimes"}},"fetch":{"baseUrl":"http://g"}}}',
]
#: A user's and a project's configuration file for each customer, and what stands in the environment.
CONFIGS = f"""SELECT c_custkey AS config_id, {_files(_GLOBAL)} AS own, {_files(_PROJECT)} AS project,
  CASE c_custkey % 3 WHEN 0 THEN 'k' WHEN 1 THEN ' ' END AS brave_key, CASE c_custkey % 4 WHEN 0 THEN 'k' END AS exa_key
FROM {{customer}}"""

# What a scraping service answers for each page: its text, raw HTML, nothing, an error, or no JSON.
SCRAPED = """SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS http_status, CASE page_id % 7
  WHEN 0 THEN '{{"success":false,"error":"quota"}}' WHEN 1 THEN '{{"success":false,"error":7}}' WHEN 2 THEN '{{"data":{{"markdown":"  "}}}}' WHEN 3 THEN 'oops'
  WHEN 4 THEN concat('{{"data":{{"markdown":5,"html":"<p>', page_id, '</p>","metadata":{{"title":"T', page_id, '","sourceURL":"http://final/', page_id, '"}}}}}}')
  ELSE concat('{{"success":true,"data":{{"markdown":"', repeat('word ', CAST(page_id % 900 AS INT)), 'end","metadata":{{"title":["x"]}}}}}}') END AS body FROM {pages}"""

# Calls of tools: the n-th event of a user starts one, and most end, up to six events later; so calls of one tool are nested,
# crossed, left open, and ended twice.
CALLS = """SELECT session_id, tool_name, pos, phase, ms, failed FROM (
  SELECT user_id AS session_id, CASE CAST(n % 2 AS INT) WHEN 0 THEN 'bash' ELSE 'read' END AS tool_name, CAST(8 * n AS BIGINT) AS pos, 'start' AS phase, event_id * 1000 AS ms, CAST(NULL AS BOOLEAN) AS failed FROM {events_n}
  UNION ALL SELECT user_id, CASE CAST(n % 2 AS INT) WHEN 0 THEN 'bash' ELSE 'read' END, CAST(8 * (n + n * 5 % 7) + 1 + n % 3 AS BIGINT), 'end', event_id * 1000 + event_id % 700, event_id % 13 = 0 FROM {events_n} WHERE n % 9 <> 4
  UNION ALL SELECT user_id, 'bash', CAST(8 * n + 7 AS BIGINT), 'end', event_id * 1000 + 900, true FROM {events_n} WHERE n % 11 IN (1, 2)) c""".replace(
    "{events_n}", "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) e"
)


TABLES = ("pages", "conversations", "events", "nation", "documents", "customer")


def load(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """Runs one of these texts, or another, over the tables that it names in braces; those in more are taken from there."""
    names = [n for n in TABLES if "{" + n + "}" in sql and n not in more]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **tables, **more)


def oracle(sql: str) -> str:
    """The same text for DuckDB."""
    names = {n: n for n in TABLES}
    return sql.format(**names, urls="urls")
