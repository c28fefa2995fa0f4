"""Core expressions and operators on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.__main__ import main
from marginalia.functions import options
from marginalia.functions import text as T
from marginalia.functions import urls as U
from marginalia.operators import evaluate as V
from marginalia.operators import search as S
from marginalia.operators import temporal as R
from marginalia.operators.prefix import running


def test_lines_and_fold(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "\n"), (4, "Straße ſ İ ς")], "id int, t string")
    got = {r["id"]: r["x"] for r in rows.select("id", T.lines(F.col("t")).alias("x")).collect()}
    assert all(got[i] == t.splitlines() for i, t in ((1, text), (2, ""), (3, "\n")))
    assert rows.filter("id = 4").select(T.fold("t")).first()[0] == "Straße ſ İ ς".casefold()


def test_literal_column_after_growing_fold(spark):
    rows = spark.createDataFrame([(1, "none\n" + "ß" * 100 + "NEEDLE x")], "k int, value string")
    hit = S.literal_lines(rows, "k", F.col("value"), "needle").first()
    assert hit["line"] == 2
    assert hit["column"] == 101 and hit["text_start"] == 40 and hit["text_truncated"]


def test_fold_equals_casefold(spark):
    chars = [chr(c) for c in [*range(0x80, 0x1C80), *range(0x1C90, 0x2C60), *range(0xFB00, 0xFF60), *range(0x10400, 0x10480), *range(0x1E900, 0x1E944)]]
    rows = spark.createDataFrame([(i, f"A{c}Z") for i, c in enumerate(chars)], "i int, t string")
    got = {r["i"]: r["f"] for r in rows.select("i", T.fold("t").alias("f")).collect()}
    assert [c for i, c in enumerate(chars) if got[i] != f"A{c}Z".casefold()] == []


def test_ranked_files_with_evidence(spark):
    rows = [("a", "x", ["Red"], "Straße.md", "one\ntwo NEEDLE x"), ("b", "needle", None, None, None), ("c", "", [], "c", "red"), ("d", "", ["t", "a needle"], "red", ""), (None, None, None, None, None)]
    files = spark.createDataFrame(rows, "p string, title string, tags array<string>, name string, text string")
    args = (files, "p", F.col("title"), F.col("tags"), F.col("name"), F.col("text"))
    got = {r["p"]: r for r in S.ranked_files(*args, ["needle", "RED"], "any", None, evidence=True).collect()}
    assert {p: (r["priority"], r["matched_lines"], r["first_line"], r["field"], r["column"], r["preview"]) for p, r in got.items()} == {
        "a": (3, 1, 2, "text", 5, "two NEEDLE x"), "b": (4, 0, None, "title", 1, "needle"), "c": (1, 1, 1, "text", 1, "red"), "d": (3, 0, None, "tags", 3, "a needle"),
    }
    assert [r["p"] for r in S.ranked_files(*args, ["needle", "RED"], "all", 5).collect()] == ["d", "a"]
    assert [r["p"] for r in S.ranked_files(*args, ["strasse"], "all", 5).collect()] == ["a"]


def test_running_sums_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randint(0, 40), i, rng.randint(-5, 5)) for i in range(400)] + [("n", None, 1, 1), (None, 3, 2, 2), (None, 4, 3, 5)]
    frame = spark.createDataFrame(rows, "k string, o int, i int, v int")
    got = {r["i"]: (r["s"], r["m"]) for r in running(running(frame, "k", "o", F.col("v"), "sum", "s", "i"), "k", "o", F.col("v"), "max", "m", "i").filter("k in ('a', 'b')").collect()}
    for k in "ab":
        own = sorted((o, i, v) for key, o, i, v in rows if key == k)
        for n in range(len(own)):
            values = [v for _, _, v in own[: n + 1]]
            assert got[own[n][1]] == (sum(values), max(values))


def test_anchors_over_many_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, float(rng.randint(0, 200))]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, t double, i int")
    got = R.anchored(frame, "k", "t", 7.0).collect()
    assert len(got) == 500 and not any(r["hit"] for r in got if r["t"] is None)
    for key in ("x", "y", None):
        until, want = float("-inf"), []
        for t in sorted(t for k, t, _ in rows if k == key and t is not None):
            want.append((t, t < until))
            until = until if t < until else t + 7
        assert sorted((r["t"], r["hit"]) for r in got if r["k"] == key and r["t"] is not None) == sorted(want)


def test_budget_of_a_batch(spark):
    took = [3.0, 1.0, 4.0, 2.0, 9.0, 1.0, 1.0]
    items = spark.createDataFrame([(0, i, t) for i, t in enumerate(took)], "b int, i int, took double")
    got = R.within_budget(items, "b", "i", "took", 6.0, 2).orderBy("i").collect()
    assert [(r["started"], r["state"]) for r in got] == [(0, "completed"), (0, "completed"), (1, "completed"), (3, "completed"), (5, "timed_out"), (5, "completed"), (None, "not_started")]
    assert {r["state"] for r in R.within_budget(items, "b", "i", "took", 6.0, 2, spent=6.0).collect()} == {"not_started"}
    assert R.budget_summary(R.within_budget(items, "b", "i", "took", 6.0, 2), "b").first().asDict() == {"b": 0, "completed": 5, "timed_out": 1, "not_started": 1, "complete": False}
    for bad in (0, -1, 601, float("nan")):
        with pytest.raises(ValueError):
            R.checked_budget(bad)


def test_shared_loads_and_cooldowns(spark):
    rows = [("u", 0.0, 4.0, False), ("u", 1.0, 2.0, True), ("u", 2.0, 9.0, True), ("u", 5.0, 9.0, True), ("u", 7.0, 1.0, True), ("u", 30.0, 1.0, False), ("v", 1.0, 1.0, True)]
    log = spark.createDataFrame(rows, "k string, t double, took double, ok boolean")
    got = [(r["role"], r["finished"], r["done"]) for r in R.shared_loads(log, "k", "t", "took", "ok", 10.0).filter("k = 'u'").orderBy("t").collect()]
    assert got == [("owner", 4.0, False), ("retry", 6.0, True), ("follower", 6.0, True), ("follower", 6.0, True), ("hit", 7.0, True), ("owner", 31.0, False)]
    asked = [(0, 0.0, "a", 10.0, 60.0), (0, 1.0, "b", 5.0, 60.0), (0, 2.0, "c", 20.0, 60.0), (0, 3.0, "d", None, 60.0), (0, 4.0, "a", None, 6.0), (0, 30.0, "a", None, 1.0)]
    log = spark.createDataFrame(asked, "p int, t double, o string, d double, left double")
    got = [(r["wait"], r["state"]) for r in R.cooldown_replay(log, "p", "t", "o", "d", "left", most=2).orderBy("t").collect()]
    assert got == [(0, "sent"), (0, "sent"), (0, "sent"), (19, "sent"), (18, "cooldown"), (0, "sent")]


def test_refresh_retry_progress_and_bytes(spark):
    log = spark.createDataFrame([("u", float(t), f) for t, f in ((0, False), (1, False), (2, True), (3, False), (13, False))], "k string, t double, f boolean")
    assert [r["hit"] for r in R.refreshed(log, "k", "t", "f", 10.0).orderBy("t").collect()] == [False, True, False, True, False]
    tries = spark.createDataFrame([("a", 1, 503, 5.0), ("a", 2, 503, None), ("b", 1, 404, None)], "r string, n int, s int, d double")
    assert [(r["next"], r["wait"]) for r in R.retry_states(tries, "r", "n", "s", "d").orderBy("r", "n").collect()] == [("retry", 5.0), ("given_up", None), ("done", None)]
    steps = spark.createDataFrame([("p", t / 100, v) for t, v in enumerate([1, 3, 2, 3, 5, 9])], "k string, t double, v int")
    assert [r["v"] for r in R.increasing(steps, "k", "t", "v").orderBy("t").collect()] == [1, 3, 5, 9]
    assert [r["v"] for r in R.increasing(steps, "k", "t", "v", 0.1).collect()] == [9]
    page = spark.createDataFrame([("ä", None, [("t", "u")])], "a string, b string, r array<struct<text:string,url:string>>")
    assert R.cache_bytes(page, "a", "b", "r").first()["size"] == 2 + len('[{"text":"t","url":"u"}]')


def test_options(monkeypatch):
    limit = options.Whole(5, 1, 9)
    assert limit.checked("n", 9) == 9 and limit.from_env("MARGINALIA_NONE") == 5
    for bad in (True, "3", 0, 10, 2.0):
        with pytest.raises(ValueError):
            limit.checked("n", bad)
    monkeypatch.setenv("MARGINALIA_N", "7")
    assert limit.from_env("MARGINALIA_N") == 7
    monkeypatch.setenv("MARGINALIA_N", "x")
    with pytest.warns(UserWarning):
        assert limit.from_env("MARGINALIA_N") == 5


def test_reference_keys(spark):
    urls = ["http://A.org:80/x/", "http://a.org/x?q#f", "https://a.org/x", "http://a.org", "ftp://a.org/", "http://u@a.org/", "http://a.org/a b", None]
    got = [r["k"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(V.url_key(F.col("u")).alias("k")).collect()]
    assert got[0] == got[1] == "http a.org 80 /x" and got[2] == "https a.org 443 /x" and got[3] == "http a.org 80 /" and got[4:] == [None] * 4
    results = spark.createDataFrame([(1, "c", 1, "http://b.org/"), (1, "c", 2, "http://a.org/x/"), (2, "c", 1, "http://x/")], "run int, case_id string, rank int, url string")
    checked = V.judged(results, spark.createDataFrame([("c", "http://a.org/x"), ("c", "bad")], "case_id string, url string"), F.col("host") == "a.org")
    runs = spark.createDataFrame([(1, "s", True, 1.0), (2, "s", False, 2.0), (3, "s", None, 9.0)], "run int, strategy string, complete boolean, elapsed double")
    assert V.summary(V.run_scores(runs, checked), "strategy").first().asDict() == {"strategy": "s", "runs": 3, "with_results": 2, "reference_found": 1, "mean_reciprocal_rank": 0.1667, "complete_searches": 1, "incomplete_without_reference": 2, "domain_violations": 2, "median_elapsed_seconds": 2.0}


def test_report_is_replaced_as_a_whole(spark, tmp_path):
    for n in (3, 1):
        V.write_report(spark.range(n), str(tmp_path / "report"))
        assert spark.read.json(str(tmp_path / "report")).count() == n
    assert not (tmp_path / "report.draft").exists()


def test_command_line(capsys):
    assert main(["list"]) == 0 and "doc_literal_lines" in capsys.readouterr().out
    with pytest.raises(SystemExit) as end:
        main(["--version"])
    assert end.value.code == 0


def test_query_words():
    assert T.words("Straße STRASSE a　b a") == ["Straße", "a", "b"]
    with pytest.raises(ValueError):
        T.words(" ".join(map(str, range(17))))


@pytest.mark.parametrize("url,want", [("HTTP://Example.COM:80", "http://example.com/"), ("https://a.b/x?q#f", "https://a.b/x?q"), ("http://user@h/", None), ("ftp://h/", None), ("http://h:99999/", None), ("http://[::1]:8080/", "http://[::1]:8080/"), ("http://bücher.de/", "http://xn--bcher-kva.de/"), ("http://h\\x/", None)])
def test_identity(url, want):
    assert (U.identity(url) or (None,))[0] == want


def test_domains_and_unwrap(spark):
    rows = spark.createDataFrame([("a.example.com", "//d/l/?uddg=https%3A%2F%2Fx.org%2Fy"), ("evilexample.com", "https://b/ck/a?x=1&u=a1aHR0cHM6Ly94Lm9yZw")], "h string, u string")
    got = rows.select(U.in_domains(F.col("h"), ["example.com"]).alias("i"), U.unwrap_ddg(F.col("u")).alias("d"), U.unwrap_bing(F.col("u")).alias("b")).collect()
    assert [r["i"] for r in got] == [True, False] and got[0]["d"] == "https://x.org/y" and got[1]["b"] == "https://x.org"


def test_budget_and_pacing(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 9, 3, 7])], "g string, i int, n int")
    assert [r["allowed"] for r in S.char_budget(rows, "n", "i", "g", 6, 13).orderBy("i").collect()] == [5, 6, 2, 0]
    log = spark.createDataFrame([("k", t, i) for i, t in enumerate([0.0, 1.0, 50.0])], "k string, t double, i int")
    assert [r["start"] for r in R.pacing(log, "k", "t", "i", 10.0).orderBy("i").collect()] == [0.0, 10.0, 50.0]
    times = spark.createDataFrame([("k", float(t)) for t in (0, 4, 8, 11, 21)], "k string, t double")
    assert [r["hit"] for r in R.anchored(times, "k", "t", 10.0).orderBy("t").collect()] == [False, True, True, False, False]


def test_lru_and_redirects(spark):
    reads = [("a", 4), ("b", 4), ("a", 4), ("c", 4), ("b", 4), ("d", 99), ("c", 4)]
    log = spark.createDataFrame([(float(i), i, k, n) for i, (k, n) in enumerate(reads)], "t double, ord int, key string, size long")
    got = R.lru_replay(log, 2, 10).orderBy("t").collect()
    assert [r["hit"] for r in got] == [False, False, True, False, False, False, True]
    assert [r["evicted"] for r in got] == [[], [], [], ["b"], ["a"], [], []]
    assert not any(r["hit"] for r in R.lru_replay(log, 0, 10).collect())
    hops = spark.createDataFrame([(f"u{i}", 302, f"u{i + 1}") for i in range(9)] + [("x", 200, "y"), ("l", 301, "l")], "url string, status int, target string")
    ends = R.redirect_ends(spark.createDataFrame([("u4",), ("u3",), ("x",), ("l",)], "url string"), hops).collect()
    assert {r["url"]: (r["final_url"], r["state"]) for r in ends if r["url"] not in "u3l"} == {"u4": ("u9", "done"), "x": ("x", "done")}
    assert {r["url"] for r in ends if r["state"] != "done"} == {"u3", "l"}


def test_page_slice(spark):
    page = spark.createDataFrame([("a😀bcd",)], "t string").select(T.page_slice(F.col("t"), 1, 3).alias("p")).first()["p"]
    assert (page["body"], page["total_chars"], page["start_index"], page["end_index"], page["next_index"]) == ("😀bc", 5, 1, 4, 4)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
