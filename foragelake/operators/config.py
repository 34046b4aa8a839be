"""Configuration files as columns of JSON text: read, overlaid layer by layer, checked and resolved.

What isn't of the type it should be is as good as absent. A layer replaces a section whole when it names another provider;
otherwise what it sets (options and fanout each as a whole) replaces what stood there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foragelake.functions.text import let, trim

# Fixed values.
PROVIDERS = ("duckduckgo", "searxng", "brave", "youcom", "exa", "tavily")
HOSTED = PROVIDERS[1:]
FETCHERS = ("http", "firecrawl")
FANOUT_MODES = ("off", "on", "auto")
MODES = ("compact", "preview", "verbose")
INVALID_SEARCH = "SearXNG search requires backends.search.baseUrl."
INVALID_FETCH = "Firecrawl fetch requires backends.fetch.baseUrl."

SEARCH = "struct<provider:string,base_url:string,fallback:string,options:struct<categories:array<string>,language:string,safesearch:int>,fanout:struct<mode:string,providers:array<string>>>"
FETCH = "struct<provider:string,base_url:string,api_key:string,fallback:string,options:struct<formats:array<string>,only_main:boolean>>"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def text(v: Column, path: str) -> Column:
    """The string at a path; null where there is none, or something else."""
    return F.when(_is(_at(v, path), "STRING"), F.try_variant_get(v, f"$.{path}", "string"))


def strings(v: Column, path: str) -> Column:
    """The array at a path if it holds nothing but strings."""
    items = F.try_variant_get(v, f"$.{path}", "array<variant>")
    only = F.forall(items, lambda x: _is(x, "STRING"))
    return F.when(_is(_at(v, path), "ARRAY") & only, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def _one_of(c: Column, values: tuple[str, ...]) -> Column:
    return F.when(c.isin(*values), c)


def _unless_empty(s: Column, *fields: str) -> Column:
    return F.when(F.coalesce(*[s[f].cast("string") for f in fields]).isNotNull(), s)


def parse_backends(json: Column) -> Column:
    """Struct (search, fetch) of a configuration file; each null where the file says nothing valid about it."""
    return let(F.try_parse_json(json), _backends)


def _backends(v: Column) -> Column:
    provider = _one_of(text(v, "backends.search.provider"), PROVIDERS)
    own = provider == "searxng"
    level = F.when(~_is(_at(v, "backends.search.options.safesearch"), "STRING") & ~_is(_at(v, "backends.search.options.safesearch"), "BOOLEAN"), F.try_variant_get(v, "$.backends.search.options.safesearch", "double"))
    options = F.struct(strings(v, "backends.search.options.categories").alias("categories"), text(v, "backends.search.options.language").alias("language"), F.when(level.isin(0.0, 1.0, 2.0), level.cast("int")).alias("safesearch"))
    options = F.when(own, let(options, lambda o: _unless_empty(o, "categories", "language", "safesearch")))
    mode = _one_of(text(v, "backends.search.fanout.mode"), FANOUT_MODES)
    # One entry that isn't a provider makes the whole list, and with it the section, invalid.
    listed = _is(_at(v, "backends.search.fanout.providers"), "ARRAY")
    names = strings(v, "backends.search.fanout.providers")
    known = names.isNotNull() & F.coalesce(F.forall(names, lambda p: p.isin(*PROVIDERS)), F.lit(False))
    fanout = F.when(mode.isNotNull() & (~listed | known), F.struct(mode.alias("mode"), F.when(listed & (F.size(names) > 0), names).alias("providers")))
    search = F.struct(
        provider.alias("provider"),
        F.when(own, text(v, "backends.search.baseUrl")).alias("base_url"),
        F.when(provider.isNotNull(), _one_of(text(v, "backends.search.fallback"), ("duckduckgo",))).alias("fallback"),
        options.alias("options"),
        fanout.alias("fanout"),
    )
    reader = _one_of(text(v, "backends.fetch.provider"), FETCHERS)
    main = F.when(_is(_at(v, "backends.fetch.options.onlyMainContent"), "BOOLEAN"), F.try_variant_get(v, "$.backends.fetch.options.onlyMainContent", "boolean"))
    reading = F.struct(strings(v, "backends.fetch.options.formats").alias("formats"), main.alias("only_main"))
    fetch = F.struct(
        reader.alias("provider"),
        text(v, "backends.fetch.baseUrl").alias("base_url"),
        text(v, "backends.fetch.apiKey").alias("api_key"),
        _one_of(text(v, "backends.fetch.fallback"), ("http",)).alias("fallback"),
        let(reading, lambda o: _unless_empty(o, "formats", "only_main")).alias("options"),
    )
    return F.struct(F.when(provider.isNotNull() | fanout.isNotNull(), search).cast(SEARCH).alias("search"), F.when(reader.isNotNull(), fetch).cast(FETCH).alias("fetch"))


def _overlay(base: Column, over: Column, fields: tuple[str, ...]) -> Column:
    switched = over["provider"].isNotNull() & (over["provider"] != base["provider"])
    both = [F.when(switched, over[f]).otherwise(F.coalesce(over[f], base[f])).alias(f) for f in fields]
    return F.struct(F.coalesce(over["provider"], base["provider"]).alias("provider"), *both)


def merge_backends(*layers: Column) -> Column:
    """Struct (search, fetch) of the defaults with all layers of parse_backends() over them, in order."""
    none = {k: F.lit(None).cast(t) for k, t in (("search", SEARCH), ("fetch", FETCH))}
    search = F.struct(F.lit("duckduckgo").alias("provider"), *[none["search"][f].alias(f) for f in ("base_url", "fallback", "options", "fanout")])
    fetch = F.struct(F.lit("http").alias("provider"), *[none["fetch"][f].alias(f) for f in ("base_url", "api_key", "fallback", "options")])
    out = F.struct(search.alias("search"), fetch.alias("fetch"))
    for layer in layers:
        out = let(F.struct(out.alias("base"), layer.alias("over")), lambda x: F.struct(
            _overlay(x["base"]["search"], x["over"]["search"], ("base_url", "fallback", "options", "fanout")).alias("search"),
            _overlay(x["base"]["fetch"], x["over"]["fetch"], ("base_url", "api_key", "fallback", "options")).alias("fetch"),
        ))
    return out


def backend_issues(c: Column) -> Column:
    """Messages of what is wrong with a merged configuration, in a fixed order."""
    s, f = c["search"], c["fetch"]
    no_url = F.nullif(s["base_url"], F.lit("")).isNull()
    checks = [
        ((s["provider"] == "searxng") & no_url, "search provider searxng requires backends.search.baseUrl"),
        ((f["provider"] == "firecrawl") & F.nullif(f["base_url"], F.lit("")).isNull(), "fetch provider firecrawl requires backends.fetch.baseUrl"),
        ((s["fallback"] == "duckduckgo") & ~s["provider"].isin(*HOSTED), "search fallback duckduckgo is only supported when search provider is searxng, brave, youcom, exa, or tavily"),
        ((f["fallback"] == "http") & (f["provider"] != "firecrawl"), "fetch fallback http is only supported when fetch provider is firecrawl"),
        (F.size(s["options"]["categories"]) == 0, "search options.categories must contain at least one category when provided"),
        (trim(s["options"]["language"]) == "", "search options.language must not be empty when provided"),
        (~s["options"]["safesearch"].isin(0, 1, 2), "search options.safesearch must be 0, 1, or 2 when provided"),
        (F.size(f["options"]["formats"]) == 0, "fetch options.formats must contain at least one format when provided"),
        (~s["fanout"]["mode"].isin(*FANOUT_MODES), "search fanout.mode must be off, on, or auto"),
        (F.array_contains(s["fanout"]["providers"], "searxng") & no_url, "search fanout with searxng requires backends.search.baseUrl"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in checks]))


def invalid_backend(c: Column, section: str) -> Column:
    """Struct (status, code, message) that a section without the base URL it needs answers with; null for a valid one."""
    provider, message = ("searxng", INVALID_SEARCH) if section == "search" else ("firecrawl", INVALID_FETCH)
    bad = (c[section]["provider"] == provider) & F.nullif(c[section]["base_url"], F.lit("")).isNull()
    return F.when(bad, F.struct(F.lit("error").alias("status"), F.lit("BACKEND_CONFIG_INVALID").alias("code"), F.lit(message).alias("message")))


def usable_providers(base_url: Column, keys: dict[str, Column]) -> Column:
    """Providers with a key (searxng: a base URL) that isn't blank; the first needs none."""
    given = {"searxng": base_url, **keys}
    return F.array_compact(F.array(F.lit(PROVIDERS[0]), *[F.when(trim(given[p]) != "", F.lit(p)) for p in HOSTED]))


def provider_order(primary: Column, base: Column, fallback: Column) -> Column:
    return F.array_distinct(F.concat(F.array(primary), base, F.when(fallback == "duckduckgo", F.array(F.lit("duckduckgo"))).otherwise(F.array().cast("array<string>"))))


def backend_set(c: Column, usable: Column) -> Column:
    """Struct (mode, providers, fallback) of how a merged configuration searches: fanout, fallback or single.

    A fanout asks its own providers, else the usable ones, the primary first; it takes the fallback in as one of them
    instead of keeping it in reserve.
    """
    s = c["search"]
    fans = F.coalesce(s["fanout"]["mode"] != "off", F.lit(False))
    base = F.when(F.size(s["fanout"]["providers"]) > 0, s["fanout"]["providers"]).otherwise(usable)
    reserve = F.when(~fans & s["provider"].isin(*HOSTED) & (s["fallback"] == "duckduckgo"), s["fallback"])
    mode = F.when(fans, F.concat(F.lit("fanout "), s["fanout"]["mode"])).when(reserve.isNotNull(), "fallback").otherwise("single")
    providers = F.when(fans, provider_order(s["provider"], base, s["fallback"])).otherwise(F.array(s["provider"]))
    return F.struct(mode.alias("mode"), providers.alias("providers"), reserve.alias("fallback"))


def parse_presentation(json: Column) -> Column:
    """Struct (default_mode, tools: map of tool to mode) of a configuration file; unknown modes are as good as absent."""
    kind = "map<string,variant>"

    def read(v: Column) -> Column:
        # Files of old have their settings at the root.
        return let(F.coalesce(F.try_variant_get(v, "$.presentation", "variant"), v), settings)

    def settings(v: Column) -> Column:
        entries = F.transform(F.map_entries(F.try_variant_get(v, "$.tools", kind)), lambda e: F.struct(e["key"].alias("key"), _one_of(text(e["value"], "mode"), MODES).alias("value")))
        tools = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        return F.struct(_one_of(text(v, "defaultMode"), MODES).alias("default_mode"), F.coalesce(tools, F.create_map().cast("map<string,string>")).alias("tools"))

    return let(F.try_parse_json(json), read)


def resolve_mode(tool: Column, *layers: Column) -> Column:
    """The mode of a tool: its own in the last layer that has one, else the last default mode, else compact."""
    own = F.coalesce(*[x["tools"][tool] for x in reversed(layers)])
    return F.coalesce(own, *[x["default_mode"] for x in reversed(layers)], F.lit("compact"))


def scrape_outcome(url: Column, http_status: Column, body: Column) -> Column:
    """Struct (status, url, title, text, code, message, truncated) of a scraping service's answer."""

    def read(x: Column) -> Column:
        v = x["v"]
        found = F.coalesce(text(v, "data.markdown"), text(v, "data.html"), F.lit(""))
        said = F.coalesce(text(v, "error"), F.lit("Firecrawl scrape failed."))
        failed = F.when(~x["s"].between(200, 299), F.concat(F.lit("HTTP "), x["s"].cast("string"))).when(v.isNull(), F.lit("invalid JSON")).when(_is(_at(v, "success"), "BOOLEAN") & ~F.try_variant_get(v, "$.success", "boolean"), said)
        blank = trim(found) == ""
        return F.struct(
            F.when(failed.isNotNull(), "error").when(blank, "needs_headless").otherwise("ok").alias("status"),
            F.when(failed.isNotNull(), x["u"]).otherwise(F.coalesce(text(v, "data.metadata.sourceURL"), x["u"])).alias("url"),
            F.when(failed.isNull() & ~blank, text(v, "data.metadata.title")).alias("title"),
            F.when(failed.isNull() & ~blank, found).alias("text"),
            F.when(failed.isNotNull(), "FETCH_FAILED").when(blank, "WEAK_EXTRACTION").alias("code"),
            F.when(failed.isNotNull(), F.concat(F.lit("Firecrawl scrape failed: "), failed)).when(blank, "Firecrawl did not return useful page text.").alias("message"),
            (failed.isNull() & ~blank & (F.length(found) >= 4000)).alias("truncated"),
        )

    return let(F.struct(url.alias("u"), http_status.alias("s"), F.try_parse_json(body).alias("v")), read)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def backend_override(c: Column, inherited: Column) -> Column:
    """Struct (search, fetch) of what a merged configuration sets apart from the one it inherits; null sections are alike.

    Another provider takes its section along whole, else only fields that differ stay. Keys never become part of it, and
    a field that was taken back can't be told from one that was left alone.
    """

    def section(name: str, kind: str, fields: tuple[str, ...]) -> Column:
        a, b = c[name], inherited[name]
        moved = ~_same(a["provider"], b["provider"])
        parts = [F.when(moved | ~_same(a[f], b[f]), a[f]).alias(f) for f in fields]
        differs = moved
        for f in fields:
            differs = differs | (~_same(a[f], b[f]) & a[f].isNotNull())
        whole = {"provider": F.when(moved, a["provider"]).alias("provider"), **dict(zip(fields, parts, strict=True))}
        if name == "fetch":
            whole["api_key"] = F.lit(None).cast("string").alias("api_key")
        order = ("provider", "base_url", "fallback", "options", "fanout") if name == "search" else ("provider", "base_url", "api_key", "fallback", "options")
        return F.when(differs, F.struct(*[whole[k] for k in order])).cast(kind).alias(name)

    return F.struct(section("search", SEARCH, ("base_url", "fallback", "options", "fanout")), section("fetch", FETCH, ("base_url", "fallback", "options")))


def _named(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{label} "), value))


def backend_summary(c: Column, usable: Column) -> Column:
    """One line each for search, fetch and rendering of a merged configuration."""
    s, f = c["search"], c["fetch"]
    asked = F.array_join(F.coalesce(s["fanout"]["providers"], usable), ", ")
    fanout = F.when(s["fanout"]["mode"] != "off", F.concat(F.lit("fanout "), s["fanout"]["mode"], F.lit(" ("), asked, F.lit(")")))
    search = (_named("fallback", s["fallback"]), _named("categories", F.array_join(s["options"]["categories"], ",")), _named("language", s["options"]["language"]), _named("safesearch", s["options"]["safesearch"].cast("string")), fanout)
    fetch = (_named("fallback", f["fallback"]), _named("formats", F.array_join(f["options"]["formats"], ",")), _named("onlyMainContent", f["options"]["only_main"].cast("string")))

    def line(name: str, x: Column, parts: tuple[Column, ...]) -> Column:
        url = F.when(x["base_url"] != "", F.concat(F.lit("("), x["base_url"], F.lit(")")))
        return F.concat_ws(" ", F.concat(F.lit(f"{name}: "), x["provider"]), url, *parts)

    return F.concat_ws("\n", line("search", s, search), line("fetch", f, fetch), F.lit("headless: local-browser"))


def presentation_override(tools: tuple[str, ...], own: Column, *inherited: Column) -> Column:
    """Struct (default_mode, tools) of what a presentation layer sets apart from the layers below it.

    A default mode like the inherited one is left out, and so is a tool's mode that it would have anyway.
    """
    below = F.coalesce(*[x["default_mode"] for x in reversed(inherited)], F.lit("compact"))
    modes = F.map_filter(own["tools"], lambda tool, mode: tool.isin(*tools) & (mode != resolve_mode(tool, *inherited)))
    return F.struct(F.nullif(own["default_mode"], below).alias("default_mode"), modes.alias("tools"))


def presentation_summary(tools: tuple[str, ...], *layers: Column) -> Column:
    """The default mode and each tool's own mode over all layers, one line each."""
    default = F.coalesce(*[x["default_mode"] for x in reversed(layers)], F.lit("compact"))
    lines = [F.concat(F.lit(f"{t}: "), F.coalesce(*[x["tools"][t] for x in reversed(layers)], F.lit("inherit"))) for t in tools]
    return F.concat_ws("\n", F.concat(F.lit("defaultMode: "), default), *lines)
