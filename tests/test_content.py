"""Extraction, decoding, engine answers, notes, tools and streams on literal rows."""

import gzip
import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions import article as A
from marginalia.functions import encoding as C
from marginalia.operators import research as Q
from marginalia.plans import catalogue
from marginalia.sources import engines as G
from marginalia.sources import notes as N
from marginalia.streaming import events as E


@pytest.mark.parametrize(
    "body,header,want",
    [
        (b"\xef\xbb\xbfa", "text/html; charset=gbk", ("a", "utf-8", "bom", False)),
        ("中".encode("gb18030"), 'text/html; charset="gb2312"', ("中", "gb18030", "http", False)),
        (b"<meta charset=big5>" + "中".encode("big5"), "", ("<meta charset=big5>中", "big5hkscs", "meta", False)),
        (b"<script><meta charset=gbk></script>\xff", "", ("<script><meta charset=gbk></script>\ufffd", "utf-8", "default", True)),
        (b"<!-- <meta charset=gbk> --><meta http-equiv=Content-Type content='text/html; charset=euc-kr'>", "", None),
        (b" " * 1024 + b"<meta charset=gbk>", "", None),
        (b"<meta charset=utf-16le>x", "text/html; charset=nonsense", ("<meta charset=utf-16le>x", "utf-8", "meta", False)),
    ],
)
def test_decode(body, header, want):
    got = C.decode(body, header)
    assert got == want if want else got[1:3] in (("cp949", "meta"), ("utf-8", "default"))


def test_inflate():
    raw = b"abc" * 100
    squeezed = zlib.compressobj(wbits=-15)
    bare = squeezed.compress(raw) + squeezed.flush()
    assert C.inflate(gzip.compress(raw) * 2, "gzip", 1000) == raw * 2
    assert C.inflate(zlib.compress(raw), "deflate", 300) == C.inflate(bare, "deflate", 300) == raw
    for bad, limit in ((gzip.compress(raw)[:-4], 1000), (zlib.compress(raw) + b"x", 1000), (gzip.compress(raw), 299), (b"junk", 10)):
        with pytest.raises(ValueError):
            C.inflate(bad, "gzip" if bad[:1] != b"x" else "deflate", limit)


PAGE = """<html><head><title> A  <!-- --> b</title><base href="https://h.org/d/"></head><body><nav><a href=x>menu</a></nav><article>
<h2>Head <em>line</em></h2><p>One<p>Two <code>a`b</code> <a href="p?q=1#f">link</a> <a href="javascript:x">bad</a> <a href="p?q=1#f">again</a>
<pre><code class="language-py">if x:
    ```
</code></pre><ol start=9><li>nine<ul><li>sub</li></ul><li>ten</ol><ol><li>other</ol>
<table><caption>Cap</caption><tbody><tr><td rowspan=0>a<td colspan=0>b|c<tr><td>d</tbody><tbody><tr><td>e<td>f</table></article><footer>foot</footer>"""


def test_page_titles_give_the_rows_of_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    titles = ["<title>a &amp;&amp; b &quot;c &amp</title>", "<TITLE x='1\n2'>\t A \r\n  B\f</Title >", "<title>\xa0 x\x0by\u3000</title>", "<title>&amp;lt; &#38; &lt;b&gt;</title>", "<title>no end", "<title<title>c</title>", "<!-- <title>first</title> --><title>second</title>", "<title>a<title>b</title>", "<title></title><title>late</title>", "<p>none", "", None]
    spark.createDataFrame(list(enumerate(titles)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in catalogue.page_titles(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(catalogue.ORACLE_SQL["page_titles"]).fetchall())
    assert [got[i] for i in (0, 1, 6, 11)] == ['a && b &quot;c &amp', "A B", "first", None]


def test_markdown():
    got = A.extract(PAGE, "http://other/")
    assert got["title"] == "A b" and got["references"] == [{"text": "link", "url": "https://h.org/d/p?q=1#f"}]
    md = got["markdown"]
    assert "## Head *line*" in md and "``a`b``" in md and "````py\nif x:\n    ```\n````" in md
    assert "[link](https://h.org/d/p?q=1#f) bad [again]" in md and "menu" not in md and "foot" not in md
    assert "9. nine\n   - sub\n10. ten\n\n<!-- -->\n\n1. other" in md
    assert "Cap\n\n|  |  |\n| --- | --- |\n| a | b\\|c |\n| a | d |\n| e | f |" in md
    assert got["code_blocks"] == got["tables"] == 1 and "One\nTwo" in got["text"] and "a | b|c" in got["text"]
    assert A.extract(None)["text"] is None and A.extract("")["markdown"] == ""
    deep = A.extract("<div>" * 5000 + "x", "")
    assert deep["text"] == "x" or deep["text_error"]


def test_engines():
    ddg = '<div class="result x"><a class=result__a href="//d/l/?uddg=https%3A%2F%2Fx.org%2Fy">T<b>i</b>t<br>le</a><a class=result__snippet>s</a></div><div class=result><a class=result__a href="javascript:1">j</a></div>'
    assert G.parse_html(ddg, "ddg", 10) == ("results", [{"rank": 1, "url": "https://x.org/y", "title": "Tit le", "snippet": "s", "source": "ddg", "engines": ["ddg"]}])
    bing = '<ol id=b_results><li class=b_algo><h2><a href="https://b/ck/a?x=1&u=a1aHR0cHM6Ly94Lm9yZw">t</a></h2><p>q</li></ol>'
    assert G.parse_html(bing, "bing", 10)[1][0]["url"] == "https://x.org"
    assert [G.parse_html(h, e, 5)[0] for h, e in (("<div class=no-results>", "ddg"), ("<ol id=b_results><li class=b_no>", "bing"), ("<p>?", "ddg"), (None, "bing"), ("<form id=challenge-form>", "ddg"))] == ["no_results", "no_results", "unknown_layout", "unknown_layout", "challenge"]
    assert G.parse_html('<p class="captcha" id="anomaly-modal">' + ddg, "ddg", 10)[0] == "results"
    assert [G.parse_html(h, "ddg", 10)[0] for h in ("<div class=anomaly-modal>", "<p id=captcha>")] == ["challenge"] * 2
    assert [G.backend_endpoint("searxng", "fallback", u) for u in ("http://h:80/", "https://h/s/search", "https://h/x")] == ["http://h/search", "https://h/s/search", "https://h/x/search"]
    assert G.backend_endpoint("builtin", "merge") is None
    for bad in (("searxng", "merge", "http://h/"), ("searxng", "fallback", ""), ("searxng", "fallback", "http://h/?q"), ("searxng", "fallback", "http://u@h/"), ("other", "fallback", "")):
        with pytest.raises(ValueError):
            G.backend_endpoint(*bad)
    asked = Q.requests_of("a b", include_domains="x.org,y.org", exclude_domains="z.y.org")
    assert asked[0][1:] == ("POST", "https://html.duckduckgo.com/html/", {"q": "(site:x.org OR site:y.org) -site:z.y.org a b"}) and asked[1][2].endswith("?q=%28site%3Ax.org+OR+site%3Ay.org%29+-site%3Az.y.org+a+b")


def test_metasearch(spark):
    bodies = [
        json.dumps({"results": [None, {"url": "http://a/", "title": " t  u ", "content": 5, "engines": ["x", "x", 3]}, {"url": "u", "title": " "}, {"url": 7, "title": "n"}, {"url": "v", "title": "w", "engines": [], "engine": "e\n f"}], "unresponsive_engines": [["e", "late"], ["?"]]}),
        "[1]", "{", None, '{"results": 5}', '{"results": [], "unresponsive_engines": 3}', json.dumps({"results": [{"url": f"u{i}", "title": "t"} for i in range(70)], "unresponsive_engines": [["a", "b"]] * 101}),
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").withColumn("x", G.metasearch(F.col("b"))).orderBy("i").collect()
    first = rows[0]["x"]
    assert (first["state"], first["invalid"], first["warnings"]) == ("results", 3, ["invalid_results:3", "e: late", "upstream_error_invalid"])
    assert [tuple(i) for i in first["items"]] == [(2, "http://a/", "t u", "", "searxng", ["x"]), (5, "v", "w", "", "searxng", ["e f"])]
    assert [r["x"]["state"] for r in rows[1:6]] == ["unknown_layout"] * 4 + ["no_results"] and rows[5]["x"]["warnings"] == ["unresponsive_engines_invalid"]
    assert len(rows[6]["x"]["items"]) == 50 and len(rows[6]["x"]["warnings"]) == 101 and rows[6]["x"]["warnings"][-1] == "upstream_errors_truncated"


def test_deep_pages():
    deep = A.extract("<div>" * 5000 + "<b>x</b>" + "</div>" * 5000, "")
    assert deep["text"] == "x" and deep["markdown"] == "**x**" and not deep["markdown_error"]
    assert A.extract("<span>" * 3000 + "y", "")["markdown"] == "y"


def _answer(group, engine, *urls, status=200):
    body = "".join(f'<div class=result><a class=result__a href="{u}">{engine}{i}</a></div>' for i, u in enumerate(urls))
    return (group, engine, status, body or "<div class=no-results>")


def test_search_and_research(spark):
    # both lists in the layout that the ddg parser reads
    rows = [_answer(0, "ddg", "https://a.org/", "https://b.com/x", "https://b.com/y"), (1, "searxng", 200, json.dumps({"results": [{"url": "https://b.com/x#f", "title": "s"}, {"url": "https://c.org/", "title": "c"}]})), _answer(2, "bing", status=429)]
    answers = spark.createDataFrame(rows, "group int, engine string, status int, body string")
    merged = Q.web_search(answers, "q", 10, "merge").payload()
    assert [r["canonical"] for r in merged["results"]] == ["https://a.org/", "https://b.com/x", "https://c.org/", "https://b.com/y"]
    assert [(p["group"], p["rank"]) for p in merged["results"][1]["provenance"]] == [(1, 1), (0, 2)]
    assert merged["search_status"] == "partial" and not merged["complete"] and merged["ok"]
    first = Q.web_search(answers, "q", 10, "fallback", exclude_domains="a.org")
    got = first.payload()
    assert got["complete"] and [r["url"] for r in got["results"]] == ["https://b.com/x", "https://b.com/y"] and got["filtered_count"] == 1
    assert Q.web_search(answers.filter("group < 2"), "q", include_domains="nowhere.net").payload()["search_status"] == "filtered_empty"
    many = Q.web_search_multi([first, Q.web_search(answers, "p", 10, "merge")]).collect()
    assert [(r["url"], r["queries"]) for r in many[:2]] == [("https://b.com/x", ["q", "p"]), ("https://b.com/y", ["q", "p"])] and len(many) == 4
    with pytest.raises(ValueError):
        Q.search_chinese(answers, "q", "nosite")
    pages = spark.createDataFrame([(u, "text/html", bytearray(f"<title>t</title><p>{'x' * 30}".encode())) for u in ("https://b.com/x", "https://b.com/y")], "url string, content_type string, body binary")
    read = Q.deep_research(first, pages, 2, 20, 32).collect()
    assert [(len(r["body"]), r["ok"], r["next_index"]) for r in read] == [(20, True, 20), (12, True, 12)]
    wanted = spark.createDataFrame([(0, "https://b.com/y"), (1, "https://no/"), (2, "https://b.com/y")], "ord int, url string")
    got = Q.fetch_pages(wanted, pages, "markdown", 10).orderBy("ord").collect()
    assert [(r["ok"], r["error"], r["body"]) for r in got] == [(True, None, "x" * 10), (False, "not_fetched", None), (True, None, "x" * 10)]
    assert not Q.package(Q.read_pages(pages), expected="0").first()["ok"]
    one = Q.fetch_page("https://b.com/x", pages, max_chars=10, start_index=25)
    assert one["ok"] and one["body"] == "x" * 5 and one["next_index"] is None and Q.render_page(one).startswith("# t\n<https://b.com/x>")
    assert not Q.fetch_page("https://b.com/x", pages, expected_content_id="0")["ok"] and Q.render_page(Q.fetch_page("u", pages)) == "u: not_fetched"
    zipped = spark.createDataFrame([("u", "text/html", "gzip", bytearray(gzip.compress(b"<title>z</title><p>y"))), ("v", "text/html", "gzip", bytearray(b"no"))], "url string, content_type string, content_encoding string, body binary")
    assert {r["url"]: r["title"] for r in Q.read_pages(zipped).collect()} == {"u": "z", "v": None}
    timed = pages.withColumn("elapsed", F.when(F.col("url") == "https://b.com/y", 4.0).otherwise(1.0))
    batch = Q.pages_payload(Q.fetch_pages(wanted, timed, "text", 10, time_budget_seconds=3.0, concurrency=1))
    assert [p["error"] for p in batch["pages"]] == ["timed_out", "not_started", "not_started"] and not batch["complete"] and not batch["ok"]
    assert Q.pages_payload(Q.fetch_pages(wanted, timed, "text", 10, time_budget_seconds=9.0, concurrency=2))["succeeded"] == 2
    late = Q.web_search(answers.withColumn("elapsed", F.col("group") * 5.0), "q", 10, "merge", time_budget_seconds=4.0).payload()
    assert [r["canonical"] for r in late["results"]] == late["urls"] == ["https://a.org/", "https://b.com/x", "https://b.com/y"] and late["search_status"] == "partial"
    multi = Q.multi_payload([first, Q.web_search(answers, "p", 10, "merge")])
    assert multi["ok"] and not multi["complete"] and [q["complete"] for q in multi["queries"]] == [True, False] and len(multi["results"]) == 4


def test_notes(spark, tmp_path):
    when = datetime(2024, 1, 2, 3, 4, 5)
    path, n = N.save_finding(str(tmp_path), "My coll", 'T "q": ß', "body Straße\nline", "https://sub.x.org/a", "Red, blue", when)
    again, m = N.save_finding(str(tmp_path), "My coll", 'T "q": ß', "other", now=when)
    assert (n, m) == (1, 2) and again.endswith("-1.md") and "/My_coll/2024-01-02-03-04-05-T_q_ß" in path
    saved = open(path, encoding="utf-8").read()
    texts = [saved, "---\ntitle: x\n---", '---\ntitle: "a"\n', "a\n---", None, '---\nother: x\ntags: []\n---', '---\ntags: ["a", 1]\n---', '---\ntitle: "a"\ntitle: "b"\n---', "---\n" + "x: 1\n" * 255 + "---", "---\n" + "x: 1\n" * 256 + "---", "---\ntitle\n---", "---\n---\ntitle: x"]
    heads = [r["m"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(N.header(F.col("t")).alias("m")).collect()]
    assert (heads[0]["title"], heads[0]["tags"], heads[0]["source_url"], heads[0]["invalid"]) == ('T "q": ß', ["Red", "blue"], "https://sub.x.org/a", False)
    assert [h["invalid"] for h in heads[1:]] == [True, True, False, False, False, True, True, False, True, True, False] and heads[5]["tags"] == []
    made = spark.createDataFrame([("My coll", 'T "q": ß', "body Straße\nline", when.isoformat(), "https://sub.x.org/a", ["Red", "blue"])], "c string, t string, b string, s string, u string, g array<string>")
    assert made.select(N.rendered(*map(F.col, "ctbsug"))).first()[0] == saved
    (tmp_path / "Node_Modules").mkdir()
    (tmp_path / ".hidden.txt").write_bytes(b"\xef\xbb\xbfSTRASSE\r\nx")
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    (tmp_path / "nul.txt").write_bytes(b"a\0")
    (tmp_path / "big.txt").write_bytes(b"x" * 2000)
    (tmp_path / "a.exe").write_bytes(b"x")
    (tmp_path / "ln.txt").symlink_to(tmp_path / "big.txt")
    got = Q.search_local(spark, "strasse", str(tmp_path), max_file_bytes=1000).payload()
    assert [(h["relpath"].split("/")[-1][:7], h["line"], h["column"]) for h in got["matches"]] == [(".hidden", 1, 1), ("2024-01", 8, 6)]
    assert not got["complete"] and got["stats"] == {"entries": 10, "files_read": 5, "files_searched": 3, "filtered_files": 0}
    assert got["skipped"] == {"excluded_dirs": 1, "extensions": 1, "links": 1, "special_files": 0, "oversized": 1, "binary": 1, "encoding": 1, "io_errors": 0, "metadata": 0}
    shown = Q.search_local(spark, "strasse", str(tmp_path), max_file_bytes=1000).render()
    assert "**.hidden.txt**\n  L1: STRASSE" in shown and "incomplete" in shown and '"oversized": 1' in shown
    files = Q.search_local(spark, "line T", str(tmp_path), collection="MY COLL", tags="red", source_domain="x.org", result_mode="files", query_mode="all").payload()
    assert [h["relpath"] for h in files["matches"]] == [path.removeprefix(f"{tmp_path}/")] and files["stats"]["filtered_files"] == 3 and files["stats"]["matched_files"] == 1
    assert files["matches"][0]["metadata"]["tags"] == ["Red", "blue"] and not files["matches"][0]["metadata"]["truncated"] and files["matches"][0]["field"] == "text"
    late = Q.search_local(spark, "x", str(tmp_path), time_budget_seconds=1e-9).payload()
    assert late["stop_reason"] == "time_budget" and late["matches"] == [] and not late["complete"]
    assert len(Q.search_local(spark, "", str(tmp_path), collection="my coll").payload()["matches"]) == 2
    capped = Q.search_local(spark, "x", str(tmp_path), max_entries=1).payload()
    assert capped["stop_reason"] == "max_entries" and not capped["complete"]
    for bad in ({"query": " "}, {"max_results": 0}, {"max_results": True}, {"result_mode": "x"}, {"no_option": 1}, {"exclude_dirs": "a/b"}):
        with pytest.raises(Exception):
            Q.search_local(spark, **({"query": "x", "root": str(tmp_path)} | bad)).payload()


def test_streams(spark, tmp_path):
    rows = spark.sql("select * from values (1L, timestamp_ntz'2024-01-01 00:00:00'), (1L, timestamp_ntz'2024-01-01 00:05:00'), (1L, timestamp_ntz'2024-01-01 03:00:00'), (2L, null) t(user_id, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    part = next((tmp_path / "events.parquet").glob("part-*"))
    (tmp_path / "s").mkdir()
    part.rename(tmp_path / "s" / "events.parquet")
    got = E.settle(E.sessions(E.read_events(spark, str(tmp_path / "s")), "user_id", "1 hour", "1 day")).orderBy("start").collect()
    assert [(r["user_id"], r["events"]) for r in got] == [(1, 2), (1, 1)]
    log = E.read_events(spark, str(tmp_path / "s")).filter("ts is not null").withColumn("t", F.unix_micros("ts") / 1e6)
    starts = [r["start"] for r in E.settle(E.paced(log.select("user_id", "t"), "user_id", 600.0), "append").orderBy("start").collect()]
    assert [b - a for a, b in zip(starts, starts[1:])] == [600.0, 10200.0]
    hits = E.settle(E.anchored(log.select("user_id", "t"), "user_id", 300.5), "append").orderBy("t").collect()
    assert [r["hit"] for r in hits] == [False, True, False]
    folder = E.settle(E.sessions(E.read_events(spark, str(tmp_path / "t")), "user_id", "1 hour", "1 day")).count() if rows.repartition(2).write.parquet(str(tmp_path / "t" / "events.parquet")) is None else 0
    assert folder == 2
    rows.limit(0).write.parquet(str(tmp_path / "e" / "events.parquet"))
    assert E.settle(E.sessions(E.read_events(spark, str(tmp_path / "e")), "user_id", "1 hour", "1 day")).count() == 0
