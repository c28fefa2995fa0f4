"""The tools: web search over captured answers, page reading, research packages, local search; each with its envelope.

"No match", "filtered to nothing" and "could not look" stay different everywhere. Rows that reach the driver are bounded by
the caller's result limit (at most 1000).
"""

from __future__ import annotations

import functools
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import urls as U
from marginalia.functions.article import extract_udf
from marginalia.functions.encoding import decode_udf, inflate_udf
from marginalia.functions.options import OneOf, Whole, checked
from marginalia.operators import search as S
from marginalia.operators import temporal as R
from marginalia.session import scratch
from marginalia.sources import engines, notes

# Sites that can be asked for by a short name.
SITES = {"zhihu": "zhihu.com", "bilibili": "bilibili.com", "weixin": "mp.weixin.qq.com", "jianshu": "jianshu.com", "csdn": "blog.csdn.net", "xueqiu": "xueqiu.com"}
FAILURES = ("limited", "challenge", "error", "unknown_layout", "timed_out")


def tool_error(message: str, response_format: str = "json") -> str:
    return json.dumps({"ok": False, "error": message}, ensure_ascii=False) if response_format == "json" else message


def candidates(answers: DataFrame, include: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """answers (group, engine, status, body), one row an engine asked, to (candidates with kept, a state row an engine)."""
    late = F.col("_late") if "_late" in answers.columns else F.lit(False)
    parsed = engines.parsed(answers).withColumn("state", F.when(late, F.lit("timed_out")).otherwise(F.coalesce(engines.status_state(F.col("status")), F.col("x.state"))))
    rows = parsed.filter(F.col("state") == "results").select("group", "engine", F.explode("x.items").alias("i")).select("group", "engine", "i.*")
    rows = rows.withColumn("id", U.identity_udf("url")).withColumn("canonical", F.col("id.canonical_url")).withColumn("host", F.col("id.host")).drop("id")
    kept = F.col("canonical").isNotNull() & ~U.in_domains(F.col("host"), exclude)
    rows = rows.withColumn("kept", kept & U.in_domains(F.col("host"), include) if include else kept)
    counts = rows.groupBy("group").agg(F.count_if("kept").alias("accepted"), F.count_if(~F.col("kept")).alias("filtered"))
    state = parsed.select("group", "engine", "state", F.col("x.warnings").alias("warnings")).join(counts, "group", "left").fillna(0, ["accepted", "filtered"])
    status = F.when(F.col("state").isin(*FAILURES), F.col("state")).when(F.col("accepted") > 0, F.lit("results")).when(F.col("filtered") > 0, F.lit("filtered_empty")).otherwise(F.lit("no_results"))
    return rows, state.withColumn("state", status)


@dataclass
class Outcome:
    """Results (canonical, url, title, snippet, provenance) in order, and the attempts that count (group, engine, state, …)."""

    query: str
    strategy: str
    results: DataFrame
    attempts: DataFrame
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def payload(self) -> dict:
        items = [r.asDict(recursive=True) for r in self.results.collect()]
        tried = [r.asDict() for r in self.attempts.orderBy("group").collect()]
        failed = [f"{t['engine']}: {t['state']}" for t in tried if t["state"] in FAILURES] + [f"{t['engine']}: {w}" for t in tried for w in t["warnings"] or ()]
        filtered = sum(t["filtered"] for t in tried)
        status = ("partial" if failed else "results") if items else "failed" if failed else "filtered_empty" if filtered else "no_results"
        # the addresses in order, and what a batch of queries needs of each
        return {"ok": bool(items) or not failed, "query": self.query, "urls": [i["canonical"] for i in items], "search_status": status, "complete": not failed, "strategy": self.strategy, "include_domains": self.include, "exclude_domains": self.exclude, "results": items, "diagnostics": failed, "attempts": tried, "filtered_count": filtered}

    def render(self, response_format: str = "text") -> str:
        found = self.payload()
        if response_format == "json":
            return json.dumps(found, ensure_ascii=False)
        lines = [f"# {self.query} ({len(found['results'])})"]
        for i, r in enumerate(found["results"], 1):
            lines += [f"\n## {i}. {r['title']}", f"<{r['url']}>", *([f"\n{r['snippet']}"] if r["snippet"] else [])]
        return "\n".join([*lines, *(f"- {d}" for d in found["diagnostics"])])


def web_search(answers: DataFrame, query: str, max_results: int = 10, strategy: str = "fallback", include_domains: str = "", exclude_domains: str = "", time_budget_seconds: float | None = None) -> Outcome:
    """fallback: the first engine that has results; merge: all engines, rank by rank.

    With a budget and a column elapsed (seconds since the search began), engines that answered later count as timed out, and
    the others' results stand."""
    if strategy not in ("fallback", "merge"):
        raise ValueError("strategy is fallback or merge")
    if not query.strip():
        raise ValueError("the query is empty")
    include, exclude = U.normalize_domains(include_domains), U.normalize_domains(exclude_domains)
    if time_budget_seconds is not None:
        answers = answers.withColumn("_late", F.coalesce(F.col("elapsed") > R.checked_budget(time_budget_seconds), F.lit(False)))
    rows, state = candidates(answers, include, exclude)
    asked = U.over_fetch(max(1, min(50, max_results)), bool(include or exclude))  # an engine is asked for no more
    rows = rows.filter(F.col("rank") <= asked)
    if strategy == "fallback":
        first = F.min(F.when(F.col("accepted") > 0, F.col("group"))).over(Window.partitionBy())  # a row an engine
        state = state.withColumn("first", first).filter("first is null or group <= first")
        rows = rows.join(state.filter("group = first").select("group"), "group", "left_semi")
        state = state.drop("first")
    return Outcome(query, strategy, S.interleave(rows, F.col("kept"), max(1, min(50, max_results))), state, include, exclude)


def requests_of(query: str, backend: str = "builtin", strategy: str = "fallback", include_domains: str = "", exclude_domains: str = "", address: str = "") -> list[tuple[str, str, str, dict[str, str]]]:
    """(engine, method, URL, fields) of the requests of a search, in the order of the engines, with the domain hints."""
    endpoint = engines.backend_endpoint(backend, strategy, address)
    asked = U.with_hints(query, U.normalize_domains(include_domains), U.normalize_domains(exclude_domains))
    return [(e, *engines.search_request(e, asked, endpoint or "")) for e in (("searxng",) if endpoint else ("ddg", "bing"))]


def search_chinese(answers: DataFrame, query: str, site: str = "zhihu", max_results: int = 10, strategy: str = "fallback") -> Outcome:
    if site.lower() not in SITES:
        raise ValueError(f"unknown site {site}; known: {', '.join(SITES)}")
    return web_search(answers, query, max_results, strategy, SITES[site.lower()])


def web_search_multi(outcomes: list[Outcome]) -> DataFrame:
    """Distinct results of several queries in the order they were first seen, with the queries that found each."""
    rows = None
    for n, outcome in enumerate(outcomes):
        one = outcome.results.withColumn("query_ord", F.lit(n)).withColumn("query", F.lit(outcome.query)).withColumn("place", F.col("first"))
        rows = one if rows is None else rows.unionByName(one)
    order = F.struct("query_ord", "place")
    merged = rows.groupBy("canonical").agg(
        F.min(order).alias("first"), F.min_by("url", order).alias("url"), F.min_by("title", order).alias("title"),
        F.min_by("snippet", F.when(F.coalesce("snippet", F.lit("")) != "", order)).alias("snippet"), F.array_sort(F.collect_set(F.struct("query_ord", "query"))).alias("q"),
    )
    return merged.select("canonical", "url", "title", "snippet", F.transform("q", lambda x: x["query"]).alias("queries"), "first").orderBy("first").drop("first")


def multi_payload(outcomes: list[Outcome]) -> dict:
    """The envelope of several queries: each with its own status and addresses; ok and complete if all are."""
    each = [o.payload() for o in outcomes]
    short = [{k: p[k] for k in ("query", "ok", "complete", "search_status", "urls", "diagnostics")} for p in each]
    return {"ok": all(p["ok"] for p in each), "complete": all(p["complete"] for p in each), "queries": short, "results": [r.asDict() for r in web_search_multi(outcomes).collect()]}


def read_pages(responses: DataFrame) -> DataFrame:
    """responses (url, content_type, body binary) to title, text, markdown, references and how the bytes were decoded."""
    body = inflate_udf("body", "content_encoding")["body"] if "content_encoding" in responses.columns else F.col("body")
    rows = responses.withColumn("d", decode_udf(body, F.col("content_type"))).withColumn("a", extract_udf("d.text", "url"))
    return rows.select("url", "a.*", F.col("d.encoding").alias("encoding"), F.col("d.source").alias("encoding_source"), F.col("d.had_errors").alias("decoding_errors"))


def package(pages: DataFrame, content_format: str = "text", start: Column | int = 0, max_chars: int = 0, expected: str = "") -> DataFrame:
    """ok, error, content_id, warnings and the slice of each page; a format that is missing or another version is a failure."""
    if content_format not in ("text", "markdown"):
        raise ValueError("content_format is text or markdown")
    body = F.coalesce(F.col(content_format), F.lit(""))
    rows = pages.withColumn("_whole", body).withColumn("content_id", F.when(body != "", T.version_id(body, content_format == "markdown")))
    stale = (F.col("content_id") != F.lit(expected)) if expected else F.lit(False)
    error = F.when(F.col("_whole") == "", F.coalesce(F.col(f"{content_format}_error"), F.lit("no_content"))).when(stale, F.lit("content_changed"))
    more = F.array(F.when(F.col("decoding_errors"), F.lit("decoding_errors")), F.when(F.col("markdown_error").isNotNull(), F.lit("markdown_unavailable")))
    warned = F.concat(T.warnings_of(F.col("_whole"), F.col("title")), F.filter(more, lambda w: w.isNotNull()))
    rows = rows.withColumn("error", error).withColumn("ok", error.isNull()).withColumn("warnings", F.when(F.col("ok"), warned))
    page = T.page_slice(F.when(F.col("ok"), F.col("_whole")).otherwise(F.lit("")), start, max_chars or None)
    return rows.withColumn("p", page).select("url", "title", "ok", "error", "content_id", "warnings", "references", "p.*")


def fetch_pages(wanted: DataFrame, responses: DataFrame, content_format: str = "text", max_chars: int = 30_000, time_budget_seconds: float | None = None, concurrency: int = 5, spent: float = 0.0) -> DataFrame:
    """wanted (ord, url): each page once extracted, then given to every request, in order and with repeats; unknown ones fail.

    With a budget and a column elapsed of responses, requests that would not be done in time fail as timed_out or not_started."""
    asked = wanted.select("url").distinct()
    known = responses.join(asked, "url", "left_semi").dropDuplicates(["url"])
    pages = package(read_pages(known), content_format, 0, max_chars)
    if time_budget_seconds is None:
        return wanted.join(pages, "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("error", F.when(~F.col("ok"), F.coalesce("error", F.lit("not_fetched"))))
    timed = wanted.join(known.select("url", "elapsed"), "url", "left").withColumn("_batch", F.lit(0))
    timed = R.within_budget(timed, "_batch", "ord", "elapsed", time_budget_seconds, concurrency, spent).drop("_batch", "elapsed")
    rows = timed.join(pages, "url", "left")
    done = F.col("state") == "completed"
    blank = [F.when(done, F.col(c)).alias(c) for c in pages.columns if c not in ("url", "ok", "error")]
    failed = F.when(~done, F.col("state")).when(~F.coalesce("ok", F.lit(False)), F.coalesce("error", F.lit("not_fetched")))
    return rows.select(*wanted.columns, "state", "started", "finished", (done & F.coalesce("ok", F.lit(False))).alias("ok"), failed.alias("error"), *blank)


def page_payload(page: dict) -> dict:
    """The envelope of one page that package() has cut."""
    out = {"ok": page["ok"], "url": page["url"], "title": page.get("title"), "error": page.get("error")}
    if page["ok"]:
        out |= {k: page[k] for k in ("content_id", "warnings", "body", "total_chars", "start_index", "end_index", "next_index", "truncated")}
        out["references"] = [dict(r.asDict() if hasattr(r, "asDict") else r) for r in page.get("references") or ()]
    return out


def pages_payload(pages: DataFrame) -> dict:
    """The envelope of a batch: pages in order, how many came, their characters, and whether all were done."""
    rows = [r.asDict(recursive=True) for r in pages.orderBy("ord").collect()]  # a row a request
    states = {s: sum(r.get("state") == s for r in rows) for s in ("timed_out", "not_started")}
    return {"ok": any(r["ok"] for r in rows) or not rows, "succeeded": sum(r["ok"] for r in rows), "requested": len(rows), "returned_chars": sum(len(r["body"] or "") for r in rows if r["ok"]), "complete": not any(states.values()), **states, "pages": [page_payload(r) for r in rows]}


def fetch_page(url: str, responses: DataFrame, content_format: str = "text", start_index: int = 0, max_chars: int = 50_000, expected_content_id: str = "", refresh: bool = False) -> dict:
    """The envelope of one page: the first captured response, or with refresh the last (by fetched_at, where there is one)."""
    known = responses.filter(F.col("url") == url)
    if "fetched_at" in known.columns:
        known = known.orderBy(F.desc("fetched_at") if refresh else F.col("fetched_at")).limit(1)
    found = package(read_pages(known), content_format, start_index, max_chars, expected_content_id).head(1)
    return page_payload(found[0].asDict(recursive=True)) if found else {"ok": False, "url": url, "title": None, "error": "not_fetched"}


def render_page(page: dict, response_format: str = "text") -> str:
    """An envelope of one page as JSON or as text."""
    if response_format == "json":
        return json.dumps(page, ensure_ascii=False)
    if not page["ok"]:
        return f"{page['url']}: {page['error']}"
    more = [f"[{page['start_index']}-{page['end_index']} of {page['total_chars']}, next {page['next_index']}]"] if page["truncated"] else []
    return "\n".join([f"# {page['title'] or page['url']}", f"<{page['url']}>", *(f"! {w}" for w in page["warnings"]), *more, "", page["body"]])


def deep_research(outcome: Outcome, responses: DataFrame, fetch_top_n: int = 6, max_chars_each: int = 20_000, max_total_chars: int = 60_000, content_format: str = "text", time_budget_seconds: float | None = None, spent: float = 0.0) -> DataFrame:
    """The first pages of a search within a total budget of characters, best result first; the search has spent a part of the
    time budget, which the pages do not get again."""
    top = outcome.results.orderBy("first").limit(fetch_top_n).select(F.col("first.pos").alias("pos"), F.col("first.group").alias("grp"), "url")
    top = top.withColumn("ord", F.row_number().over(Window.orderBy("pos", "grp"))).select("ord", "url")  # fetch_top_n rows
    pages = fetch_pages(top, responses, content_format, 0, time_budget_seconds, spent=spent).withColumn("n", F.coalesce(F.length("body"), F.lit(0))).withColumn("all", F.lit(1))
    pages = S.char_budget(pages, "n", "ord", "all", max_chars_each, max_total_chars)  # fetch_top_n rows
    page = T.page_slice(F.coalesce("body", F.lit("")), 0, None)
    rows = pages.withColumn("p", page).withColumn("cut", F.expr("substring(p.body, 1, allowed)"))
    return rows.select("ord", "url", "title", "ok", "error", "content_id", F.col("cut").alias("body"), F.col("n").alias("total_chars"), F.when(F.col("allowed") < F.col("n"), F.col("allowed")).alias("next_index")).orderBy("ord")


@dataclass
class LocalSearch:
    """Hits, and the listing with a state for every directory entry."""

    query: str
    hits: DataFrame
    listing: DataFrame
    filtering: bool
    limit: int
    ranked: bool = False

    def payload(self) -> dict:
        found = [r.asDict(recursive=True) for r in self.hits.limit(self.limit + 1).collect()]
        states = {r["state"]: r.asDict() for r in self.listing.groupBy("state").agg(F.count("*").alias("n"), F.count_if("invalid").alias("invalid"), F.count_if("accepted").alias("accepted")).collect()}
        count = lambda s, what="n": states.get(s, {}).get(what, 0)
        skipped = {s: count(s) for s in (*notes.HARMLESS, *notes.INCOMPLETE)} | {"metadata": count("read", "invalid")}
        more = len(found) > self.limit
        stop = "time_budget" if count("time_budget") else "max_entries" if count("max_entries") else "max_results" if more else None
        whole = stop is None and not any(skipped[s] for s in notes.INCOMPLETE) and not (self.filtering and skipped["metadata"])
        stats = {"entries": sum(s["n"] for k, s in states.items() if k != "max_entries"), "files_read": count("read") + count("binary") + count("encoding"), "files_searched": count("read", "accepted"), "filtered_files": count("read") - count("read", "accepted")}
        if self.ranked:  # best files are cut from all that match, so their number is known
            stats["matched_files"] = self.hits.count()
        return {"ok": True, "query": self.query, "matches": found[: self.limit], "complete": whole, "stop_reason": stop, "stats": stats, "skipped": skipped}

    def render(self, response_format: str = "text") -> str:
        found = self.payload()
        if response_format == "json":
            return json.dumps(found, ensure_ascii=False, default=str)
        lines, last = [f"# {self.query} ({len(found['matches'])})"], None
        if not found["complete"]:
            lines.append(f"incomplete: {found['stop_reason'] or 'some files could not be searched'}")
        for hit in found["matches"]:
            if hit["relpath"] != last:
                last = hit["relpath"]
                lines.append(f"\n**{last}**")
            if hit.get("line") is not None:
                lines.append(f"  L{hit['line']}: {hit.get('text') or hit.get('value')}")
            elif hit.get("priority") is not None:
                lines.append(f"  tier {hit['priority']}, {hit['matched_lines']} lines, {hit['field']}: {hit['preview']}")
        return "\n".join([*lines, "\n" + json.dumps(found["stats"]), json.dumps({k: n for k, n in found["skipped"].items() if n})])


LOCAL = {
    "max_results": Whole(50, 1, 1000), "max_entries": Whole(notes.MAX_ENTRIES, 1, 1_000_000), "max_file_bytes": Whole(notes.MAX_BYTES, 1, 16 << 20),
    "result_mode": OneOf(("lines", "files")), "query_mode": OneOf(("literal", "all", "any")),
}


def _filter(collection: str, tags: str, source_domain: str) -> Column | None:
    """The metadata filter on the column meta; None if nothing is asked for."""
    tests = []
    if collection.strip():
        tests.append(F.trim(T.fold("meta.collection")) == collection.strip().casefold())
    if asked := sorted({t.casefold() for t in notes.listed(tags)}):
        tests.append(F.size(F.array_except(F.array(*map(F.lit, asked)), F.transform("meta.tags", T.fold))) == 0)
    if domains := U.normalize_domains(source_domain):
        tests.append(U.in_domains(U.identity_udf(F.coalesce("meta.source_url", F.lit("")))["host"], domains))
    return functools.reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests)) if tests else None


def search_local(spark: SparkSession, query: str, root: str, include_ext: str = notes.EXTENSIONS, collection: str = "", tags: str = "", source_domain: str = "", exclude_dirs: str = notes.EXCLUDED, time_budget_seconds: float | None = None, **options: object) -> LocalSearch:
    """Lines or ranked files of a folder that match; an empty query lists the files that a metadata filter keeps.

    options: max_results, max_entries, max_file_bytes, result_mode and query_mode, as LOCAL bounds them. Lines come in order of
    path and line, files best first with ties by folded path, then path. The folder is scanned once; hits and counts read the
    same written scan. What the time budget leaves unread is told, and no hit comes from it. Metadata is shown cut; filters
    and ranks use it whole."""
    chosen = {k: o.default if isinstance(o, Whole) else o.values[0] for k, o in LOCAL.items()} | checked(LOCAL, options)
    if unknown := options.keys() - LOCAL.keys():
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    keep = _filter(collection, tags, source_domain)
    if not query.strip() and keep is None:
        raise ValueError("give a query or a filter")
    spark.dataSource.register(notes.NoteFiles)
    limits = {"include_ext": include_ext, "exclude_dirs": exclude_dirs, "max_entries": chosen["max_entries"], "max_file_bytes": chosen["max_file_bytes"]}
    if time_budget_seconds is not None:
        limits["deadline"] = repr(time.time() + R.checked_budget(time_budget_seconds))
    path = scratch(spark, "notes")
    scan = spark.read.format("notes").options(**limits).load(root)
    scan.withColumn("meta", F.when(F.col("extension") == ".md", notes.header(F.col("text")))).write.parquet(path)
    files = spark.read.parquet(path)
    files = files.withColumn("invalid", F.coalesce("meta.invalid", F.lit(False))).withColumn("accepted", (F.col("state") == "read") & (F.lit(True) if keep is None else keep))
    kept = files.filter("accepted").withColumn("order", T.fold("relpath"))
    meta = T.capped_metadata(*(F.col(f"meta.{k}") for k in ("title", "collection", "saved_at", "source_url", "tags")))
    shown = kept.select(F.col("relpath").alias("_path"), "order", meta.alias("metadata"))
    mode, terms = chosen["query_mode"], [query] if chosen["query_mode"] == "literal" else T.words(query) if query.strip() else []
    if not query.strip():
        hits = kept.select("relpath", F.lit(None).cast("int").alias("line"), F.coalesce("meta.title", "name").alias("text"))
    elif chosen["result_mode"] == "files":
        hits = S.ranked_files(kept, "relpath", F.col("meta.title"), F.col("meta.tags"), F.col("name"), F.col("text"), terms, "any" if mode == "any" else "all", None, evidence=True)
    else:
        hits = S.literal_lines(kept, "relpath", F.col("text"), query) if mode == "literal" else S.term_lines(kept, "relpath", F.col("text"), terms, mode)
    hits = hits.join(shown, F.col("relpath") == F.col("_path")).drop("_path")
    first = [F.desc("priority"), "order", "relpath"] if "priority" in hits.columns else ["order", "relpath"] if not query.strip() else ["relpath", "line"]
    return LocalSearch(query, hits.orderBy(*first).drop("order"), files.select("relpath", "state", "invalid", "accepted"), keep is not None, chosen["max_results"], "priority" in hits.columns)
