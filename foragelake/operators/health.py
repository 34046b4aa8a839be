"""What a configuration's services say of themselves: one line each, from recorded probes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foragelake.functions.text import let, trim
from foragelake.operators.config import PROVIDERS
from foragelake.operators.requests import KEYS

#: A probe that takes longer is given up.
PROBE_TIMEOUT_MS = 3000
# Fixed values.
GIVEN_UP = "This operation was aborted"
RENDERING = "headless backend: local-browser (managed Chromium fallback configured)"


def _blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def _warning(what: str | Column, why: Column) -> Column:
    return F.concat(F.lit(what) if isinstance(what, str) else what, F.lit(" warning ("), why, F.lit(")"))


def probe_failure(probe: Column) -> Column:
    """Why a probe (ms, http_status, body, failure) brought no answer; null where it did."""
    return F.when(probe["ms"] > PROBE_TIMEOUT_MS, F.lit(GIVEN_UP)).otherwise(probe["failure"])


def health_lines(c: Column, keys: dict[str, Column], search_probe: Column, fetch_probe: Column) -> Column:
    """Array of lines on search, its fallback and fanout, fetch, its fallback, and rendering.

    c: a merged configuration; keys: each hosted provider's key, blank or null for none. A probe that took over
    PROBE_TIMEOUT_MS counts as given up whatever came of it; one whose body isn't JSON has failed.
    """

    def lines(x: Column) -> Column:
        s, f = x["c"]["search"], x["c"]["fetch"]
        provider = s["provider"]
        missing = F.when((provider == "searxng") & _blank(s["base_url"]), F.lit("missing baseUrl"))
        for name, variable in KEYS.items():
            missing = missing.when((provider == name) & _blank(x["keys"][name]), F.lit(f"missing {variable}"))
        v = F.try_parse_json(x["s"]["body"])
        path = F.when(provider == "brave", F.try_variant_get(v, "$.web.results", "array<variant>")).otherwise(F.try_variant_get(v, "$.results", "array<variant>"))
        good = x["s"]["http_status"].between(200, 299)
        # A searxng answer is read before its status is looked at.
        status = F.when(~good & (provider != "searxng"), F.concat(F.lit("HTTP "), x["s"]["http_status"].cast("string")))
        why = F.coalesce(missing, probe_failure(x["s"]), status, F.when(v.isNull(), "invalid JSON"), F.when(~good | path.isNull(), "unexpected response"))
        head = F.concat(F.lit("search backend: "), provider)
        search = F.when(provider == PROVIDERS[0], head).when(why.isNull(), F.concat(head, F.lit(" ok"))).otherwise(_warning(head, why))

        fans = s["fanout"]["mode"].isNotNull() & (s["fanout"]["mode"] != "off")
        asked = F.coalesce(s["fanout"]["providers"], F.array(*map(F.lit, PROVIDERS)))

        def each(p: Column) -> Column:
            lacks = F.when((p == "searxng") & _blank(s["base_url"]), F.lit("missing baseUrl"))
            for name, variable in KEYS.items():
                lacks = lacks.when((p == name) & _blank(x["keys"][name]), F.lit(f"missing {variable}"))
            return F.when(lacks.isNotNull(), _warning(F.concat(F.lit("search fanout provider "), p), lacks))

        fanout = F.when(fans, F.concat(F.array(F.concat(F.lit("search fanout: "), s["fanout"]["mode"], F.lit(" ("), F.array_join(asked, ", "), F.lit(")"))), F.transform(asked, each)))
        bad = F.coalesce(F.when(_blank(f["base_url"]), "missing baseUrl"), probe_failure(x["f"]), F.when(~x["f"]["http_status"].between(200, 299), F.concat(F.lit("HTTP "), x["f"]["http_status"].cast("string"))))
        fetch = F.when(f["provider"] == "http", F.lit("fetch backend: http")).when(bad.isNull(), F.lit("fetch backend: firecrawl ok")).otherwise(_warning("fetch backend: firecrawl", bad))
        one = [F.array(search, F.concat(F.lit("search fallback: "), s["fallback"])), F.coalesce(fanout, F.array().cast("array<string>")), F.array(fetch, F.concat(F.lit("fetch fallback: "), f["fallback"]), F.lit(RENDERING))]
        return F.array_compact(F.concat(*one))

    return let(F.struct(c.alias("c"), F.struct(*[k.cast("string").alias(n) for n, k in keys.items()]).alias("keys"), search_probe.alias("s"), fetch_probe.alias("f")), lines)
