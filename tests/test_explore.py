"""The research run against a plain loop over questions, steps and pages, on whole small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foragelake.functions import urls as U
from foragelake.functions.text import WS
from foragelake.operators.evidence import GENERIC_CAVEAT, REASONS
from foragelake.plans.explore import explore, steps_of
from foragelake.plans.queries import research_inputs
from tests.conftest import SF

SPACE = WS.replace(r"\x{", r"\u{")
SPACE = re.sub(r"\\u\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE)
RANK = {"primary-content": -1, "official-docs": 0, "official-api": 1, "official-discussion": 2, "issue-thread": 3, "community": 4, "package-page": 5}
BOT = "performing security verification|security service|verify you are not a bot|just a moment|checking your browser"
TALK = "reddit|forum|forums|discussion|thread|comments|community|user experience|people recommend"


def collapse(text):
    return re.sub(f"{SPACE}+", " ", text).strip(" ")


def bot_check(title, text):
    return bool(re.search(BOT, f"{title or ''}\n{text}", re.I))


class Run:
    """One question after the other, as a person would work them off."""

    def __init__(self, url_facts, fetches, rendered):
        self.facts, self.fetches, self.rendered = url_facts, fetches, rendered

    def evidence(self, page, url, hit_title, direct):
        """(evidence, low value) of a page."""
        if page is None or page["status"] != "ok" or page["text"] is None:
            return None, None
        final = page["final_url"] or url
        kind = self.facts[final]["source_kind"]
        if bot_check(page["title"], page["text"]):
            return None, "bot-check"
        blank = not collapse(page["text"])
        primary = page["method"] in ("github", "pdf", "youtube") and (direct or not blank)
        if (direct and blank) or not (direct or primary or kind != "package-page"):
            return None, "low-value-page"
        title = page["title"] if page["title"] is not None else (final if direct else hit_title)
        text = page["text"] if primary else collapse(page["text"])
        return {"title": title, "url": final, "kind": "primary-content" if primary else kind, "method": page["method"], "summary": text if primary else text[:180], "support": text if primary else text[:120]}, None

    def render(self, url):
        page = self.rendered.get(url)
        if page is None or page["status"] != "ok" or not collapse(page["text"]) or bot_check(page["title"], page["text"]):
            return None
        text = collapse(page["text"])
        return {"title": page["title"], "url": url, "kind": self.facts[url]["source_kind"], "method": "headless", "summary": text[:180], "support": text[:120]}

    @staticmethod
    def ranked(evidence):
        best, order = {}, []
        for e in evidence:
            if e["kind"] == "package-page":
                continue
            if e["url"] not in best:
                order.append(e["url"])
            if e["url"] not in best or RANK[e["kind"]] < RANK[best[e["url"]]["kind"]]:
                best[e["url"]] = e
        return sorted((best[u] for u in order), key=lambda e: RANK[e["kind"]])

    def assess(self, ranked, gaps, low):
        kinds = [e["kind"] for e in ranked]
        official = sum(k in ("official-docs", "official-api") for k in kinds)
        hosts = {self.facts[e["url"]]["host"] for e in ranked}
        said = "\n".join(f"{e['summary']}\n{e['support']}" for e in ranked).lower()
        caution = re.search(r"\bdeprecated\b|not recommended|use at your own risk|should not", said, re.A)
        tests = {
            "community-only": bool(kinds) and not official and "primary-content" not in kinds,
            "low-diversity": len(kinds) > 1 and len(hosts) <= 1 and "primary-content" not in kinds,
            "unreadable-direct-source": any("direct url could not be read reliably" in g.lower() for g in gaps),
            "unreadable-thread-source": any("thread source could not be read reliably" in g.lower() for g in gaps),
            "possible-conflict": bool(caution and re.search(r"\brecommended\b", said.replace("not recommended", ""), re.A)),
            "bot-check": "bot-check" in low,
        }
        strong = sum(k in ("official-docs", "official-api", "official-discussion") for k in kinds)
        return [r for r in REASONS if tests[r]], official, strong, "official-docs" in kinds and "official-api" in kinds

    def next(self, ranked, gaps, low, suggested, attempts):
        reasons, official, strong, both = self.assess(ranked, gaps, low)
        concerns = [r for r in reasons if not (both and r == "low-diversity")]
        if strong >= 2 and official:
            if "community-only" in reasons or "low-diversity" in concerns:
                return "search-again"
            return "answer-with-caveat" if concerns else "answer"
        return "headless" if suggested and attempts < 2 else "search-again"

    def run(self, links, steps):
        evidence, gaps, low, attempts, suggested = [], [], [], 0, None
        for url in links[:3]:
            page = self.fetches.get(url)
            e, _ = self.evidence(page, url, None, True)
            final = page["final_url"] if page else url
            status = page["status"] if page else "error"
            retry = e is None and (status == "needs_headless" or (status == "ok" and self.facts[final]["prefers"]))
            if retry and attempts < 2:
                attempts += 1
                e = self.render(final)
            if e:
                evidence.append(e)
            elif not retry and status != "ok":
                gaps.append((page and page["message"]) or f"Direct URL fetch failed for {final}")
            else:
                gaps.append(("Thread source" if self.facts[final]["kind"] == "forum-thread" else "Direct URL") + f" could not be read reliably: {final}")
        if any(e["kind"] == "primary-content" for e in evidence):
            return self.answer("answer", evidence, gaps, low, 0, len(evidence) + len(gaps), attempts, False)
        for n, (search, query, hits) in enumerate(steps):
            if search is None or search["status"] != "ok":
                gaps.append((search and search["message"]) or "Search failed during research worker pass.")
            else:
                if not hits:
                    low.append("empty-search")
                first = {}
                for h in sorted(hits, key=lambda h: h["pos"]):
                    first.setdefault(h["url"], h)
                score = "talk" if re.search(TALK, query, re.I) else "plain"
                weak = None
                for h in sorted(first.values(), key=lambda h: (self.facts[h["url"]][score], h["pos"]))[:4]:
                    page = self.fetches.get(h["url"])
                    e, value = self.evidence(page, h["url"], h["title"], False)
                    if e:
                        evidence.append(e)
                    if value:
                        low.append(value)
                    if page is None or page["status"] not in ("ok", "needs_headless"):
                        gaps.append((page and page["message"]) or f"Fetch failed for {h['url']}")
                    elif page["status"] == "needs_headless":
                        gaps.append(f"HTTP fetch was weak for {page['final_url']}")
                        weak = weak or page["final_url"]
                if weak and "npmjs.com/package/" not in weak:
                    suggested = suggested or weak
            action = self.next(self.ranked(evidence), gaps, low, suggested, attempts)
            pages = len(evidence) + len(gaps) + len(low)
            if action == "headless":
                e = self.render(suggested)
                if e is None:
                    return self.answer("escalate-headless", evidence, gaps, low, n + 1, pages, attempts + 1, False)
                evidence.append(e)
                done = self.next(self.ranked(evidence), gaps, low, None, 0) == "answer"
                return self.answer("answer" if done else "research-again", evidence, gaps, low, n + 1, pages + 1, attempts + 1, False)
            if action != "search-again":
                return self.answer("answer" if action == "answer" else "research-again", evidence, gaps, low, n + 1, pages, attempts, False)
        return self.answer("research-again", evidence, gaps, low, len(steps), pages, attempts, True)

    def answer(self, action, evidence, gaps, low, passes, pages, attempts, exhausted):
        ranked = self.ranked(evidence)
        reasons = self.assess(ranked, gaps, low)[0]
        said = [REASONS[r] for r in reasons]
        listed = said[0] if len(said) == 1 else ", ".join(said[:-1]) + ", and " + said[-1] if said else ""
        caveat = None if action == "answer" else f"Evidence is partial: {listed}." if said else GENERIC_CAVEAT
        prefix = {"community": "Community/practical context: ", "issue-thread": "Community/practical context: "}
        return {
            "action": action, "findings": [prefix.get(e["kind"], "") + collapse(e["summary"]) for e in ranked[:5]],
            "sources": [(e["title"], e["url"], e["method"]) for e in ranked[:4]], "caveat": caveat, "search_passes": passes, "fetched_pages": pages,
            "headless_attempts": attempts, "exhausted_budget": exhausted, "reasons": reasons,
        }, [(i, e["url"], e["kind"], e["method"]) for i, e in enumerate(ranked)]


@pytest.fixture(scope="module")
def both(spark):
    """Answers and evidence of Spark, and those of the loop."""
    questions, searches, hits, fetches, rendered = research_inputs(spark, SF)
    links = {r["query_id"]: r["links"] for r in questions.select("query_id", U.direct_urls(F.col("query")).alias("links")).collect()}
    c = F.col("url")
    known = fetches.select("url").union(questions.select(F.explode(U.direct_urls(F.col("query"))))).union(hits.select("url")).distinct()
    p = U.profile(c)
    facts = known.select("url", p["kind"].alias("kind"), p["source_kind"].alias("source_kind"), p["prefers_rendering"].alias("prefers"), U.host_or_url(c).alias("host"), U.candidate_score(c, F.lit(True)).alias("talk"), U.candidate_score(c, F.lit(False)).alias("plain"))
    found = defaultdict(list)
    for r in hits.collect():
        found[r["query_id"], r["step"]].append(r.asDict())
    done = {(r["query_id"], r["step"]): r.asDict() for r in searches.collect()}
    steps = defaultdict(list)
    for r in steps_of(questions).orderBy("query_id", "step").collect():
        steps[r["query_id"]].append((done.get((r["query_id"], r["step"])), r["query"], found[r["query_id"], r["step"]]))
    run = Run({r["url"]: r.asDict() for r in facts.collect()}, {r["url"]: r.asDict() for r in fetches.collect()}, {r["url"]: r.asDict() for r in rendered.collect()})
    answers, evidence = explore(questions, searches, hits, fetches, rendered)
    told = defaultdict(list)
    for r in evidence.orderBy("query_id", "pos").collect():
        told[r["query_id"]].append((r["pos"], r["url"], r["source_kind"], r["method"]))
    return {r["query_id"]: r.asDict(recursive=True) for r in answers.collect()}, told, {q: run.run(links[q], s) for q, s in steps.items()}


def test_answers(both):
    answers, _, wanted = both
    assert set(answers) == set(wanted)
    for q, (answer, _) in wanted.items():
        got = answers[q]
        got["sources"] = [(s["title"], s["url"], s["method"]) for s in got["sources"]]
        assert {k: got[k] for k in answer} == answer, q


def test_evidence(both):
    _, told, wanted = both
    assert {q: told[q] for q in wanted} == {q: e for q, (_, e) in wanted.items()}


def test_every_kind_of_end_is_met(both):
    _, _, wanted = both
    assert {a["action"] for a, _ in wanted.values()} == {"answer", "research-again", "escalate-headless"}
    assert {a["search_passes"] for a, _ in wanted.values()} >= {0, 1} and any(len(a["reasons"]) > 1 for a, _ in wanted.values())


def test_views_say_what_the_answers_hold(spark):
    """Both texts of every question against plain strings made from its answer."""
    from foragelake.plans.queries import QUERIES, _research
    from tests.conftest import SF

    labels = {"http": "web_fetch", "headless": "web_fetch_headless"}
    answers = {r["query_id"]: r for r in _research(spark, SF)[0].collect()}
    shown = {r["query_id"]: r for r in QUERIES["explore_views"](spark, SF).collect()}
    assert answers.keys() == shown.keys() and answers
    seen = set()
    for i, a in answers.items():
        findings, sources = a["findings"], a["sources"]
        some = bool(findings or sources)
        internal = f"Internal research: web_search ×{a['search_passes']}, web_fetch ×{a['fetched_pages']}, web_fetch_headless ×{a['headless_attempts']}"
        lines = [f"- [{labels.get(sources[k]['method'] if k < len(sources) else None, None) or V_LABEL(sources, k)}] {f}" for k, f in enumerate(findings)] if some else ["No usable evidence found."]
        listed = [f"- [{labels.get(s['method']) or V_LABEL([s], 0)}] {s['title']}: {s['url']}" for s in sources]
        compact = f"Reviewed {len(sources)} sources · synthesized answer with {len(findings)} findings" if some else "No usable evidence found"
        preview = "\n".join([*lines, "\n" + internal])
        verbose = "\n".join(["Findings", *lines, "", "Sources", *listed, "\nInternal tools\n" + internal, *(["\nCaveat\n" + a["caveat"]] if a["caveat"] is not None else [])])
        text = "\n\n".join(p for p in ("\n\n".join(findings), "Sources:\n" + "\n".join(f"- {s['title']}: {s['url']}" for s in sources) if sources else "", a["caveat"] or "") if p)
        assert shown[i]["shown"] == {0: preview, 1: verbose}.get(i % 3, compact)
        assert shown[i]["model_text"] == (text if some else "No usable evidence found.")
        seen.add((some, a["caveat"] is None, i % 3))
    assert len(seen) >= 4


def V_LABEL(sources, k):
    """What other readers are called; a finding without a source of its own is the research's."""
    from foragelake.functions.views import LABELS

    return LABELS.get(sources[k]["method"], "web_explore") if k < len(sources) else "web_explore"
