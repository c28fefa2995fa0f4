"""The corpus operators against plain versions of their rules."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import htmltext, langid, licenses, quality, signatures, tokenshards, topk, toxicity

BLOCKS, INLINE = ["p", "div", "section", "h2", "blockquote", "li", "td", "details"], ["b", "i", "span", "a"]


class PageMaker:
    """Random pages with the words that a browser paints, in order."""

    def __init__(self, seed):
        self.rng, self.n = random.Random(seed), 0

    def page(self, depth, painted=True, shown=True):
        html, words = "", []
        for _ in range(self.rng.randint(1, 3)):
            kind = self.rng.randint(0, 9 if depth else 1)
            if kind < 2:
                self.n += 1
                html += f" w{self.n} "
                words += [f"w{self.n}"] if painted and shown else []
                continue
            style, p, s = "", painted, shown
            if kind == 2:
                style, p = self.rng.choice([" hidden", " style='display: none'", " style='color:red;DISPLAY:none'"]), False
            elif kind == 3:
                style, s = " style='visibility:hidden'", False
            elif kind == 4:
                style, s = " style='visibility:visible'", True
            tag = self.rng.choice(["div", "section", "blockquote", *INLINE])
            if kind == 5:
                self.n += 1
                inner, found = self.page(depth - 1, False, s)
                html += f"<details><summary>w{self.n}</summary>{inner}</details>"
                words += [f"w{self.n}"] if painted and shown else []
                continue
            if kind == 6:
                cells = [self.page(depth - 1, painted, shown) for _ in range(2)]
                html += "<table><tr>" + "".join(f"<td>{h}" for h, _ in cells) + "</table>"
                if len({len(w) <= 1 for _, w in cells}) == 1 and all(len(w) <= 1 for _, w in cells):
                    words += [w for _, ws in cells for w in ws]
                else:  # lines of cells stand beside each other: only the set is in order
                    words.append(sorted(w for _, ws in cells for w in (x if isinstance(x, str) else " ".join(x) for x in ws)))
                continue
            inner, found = self.page(depth - 1, p, s)
            html += f"<{tag}{style}>{inner}</{tag}>"
            words += found
        return html, words


def flat(words):
    for w in words:
        if isinstance(w, str):
            yield from w.split()
        else:
            yield from flat(w)


@pytest.mark.parametrize("seed", range(60))
def test_html_emits_every_painted_word_once(seed):
    html, words = PageMaker(seed).page(5)
    got = re.findall(r"w\d+", htmltext.extract(html)[1])
    assert sorted(got) == sorted(flat(words))
    if all(isinstance(w, str) for w in words):
        assert got == words


def test_html_of_any_depth():
    n = 300
    title, text = htmltext.extract("<table><tr><td>a<td>" * n + "x" + "</table>" * n)
    assert text == "a | " * n + "x"
    assert htmltext.extract("<span>" * 20_000 + "</p>" * 20_000 + "end")[1].endswith("end")
    assert htmltext.extract("<details>no<summary>s</summary>no</details><details open><summary>t</summary>u</details>")[1] == "s\nt\nu"
    assert htmltext.extract("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>")[1] == "yes"


def test_html_pages_as_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "y"), (2, "u", "<p>a", "z"), (2, "u", "<p>a", "z")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_lines"]) for r in htmltext.extract_pages(frame).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert htmltext.extract_pages(frame.limit(0)).count() == 0


def plain_path(forest, t, row):
    at = 0
    while forest.feature[t][at] >= 0:
        at = forest.child[t][at][int(row[forest.feature[t][at]] >= forest.split[t][at])]
    return forest.depth[t][at]


def test_forest_scores_equal_walks_and_threshold_equals_search(spark):
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.normal(0, 1, (400, 4)), [[9.0, 9, 9, 9]]])
    forest = quality.grow(rows, 20, 64, 1)
    want = [2 ** -(sum(plain_path(forest, t, r) for t in range(20)) / 20 / quality.expected_path(64)) for r in rows]
    assert np.allclose(forest.scores(rows), want) and int(np.argmax(want)) == 400
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) + (" ##|| %%" * (i % 7) if i % 5 == 0 else "") for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x " * 90), (7, texts[7]), (999, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.score(docs, labels).collect()
    assert quality.score(docs, labels).columns[5:8] == ["n_repeat_words", "base_failed", "kept"]
    known = [(r["anomaly"], r["doc_id"] % 5 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 150 and not r["base_failed"]]
    good = sum(g for _, g in known)
    gain = lambda at: sum(a >= at and not g for a, g in known) / (len(known) - good) - 5 * sum(a >= at and g for a, g in known) / good
    best = max(gain(b / quality.BINS) for b in range(quality.BINS + 1))
    rejected = [(a, g) for (a, g), r in zip(known, [r for r in got if r["doc_id"] is not None and r["doc_id"] < 150 and not r["base_failed"]]) if not r["kept"]]
    assert math.isclose(sum(not g for _, g in rejected) / (len(known) - good) - 5 * sum(g for _, g in rejected) / good, best, abs_tol=1e-9)
    kept = sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert sorted(str(r["doc_id"]) for r in quality.keep(docs, labels).collect()) == kept
    one_class = quality.score(docs, labels.filter("quality = 1"))
    assert one_class.filter("kept").count() == one_class.filter("not base_failed").count()
    assert quality.keep(docs.limit(0), labels).count() == 0


def test_language_masks_equal_exact_sets():
    rng = np.random.default_rng(4)
    langs = ["aa", "bb", "cc"]
    words = {x: [bytes(rng.choice(list(b"abcdefghij"[i : i + 7]), 5)).decode() for _ in range(60)] for i, x in enumerate(langs)}
    counts = {x: np.unique(np.concatenate(list(langid.grams(" ".join(w * 3)))), return_counts=True) for x, w in words.items()}
    filters = langid.build(counts, langs, 0.25)
    rate = {x: dict(zip(k.tolist(), n / n.sum())) for x, (k, n) in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r0 in rate.values() for g in r0}
    member = {x: {g for g, r in rate[x].items() if r >= 0.25 * top[g]} for x in langs}
    for x in langs:  # no false negative, and few false positives
        known = np.array(sorted(member[x]), np.uint64)
        assert (filters.masks(known) >> langs.index(x) & 1).all()
    other = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    for i in range(3):
        assert abs((filters.masks(other) >> i & 1).mean() - filters.false_rate[i]) < 0.02
    for x in langs:
        text = " ".join(words[x][:20])
        grams = np.concatenate(list(langid.grams(text)))
        exact = np.array([sum(g in member[y] for g in grams.tolist()) / len(grams) for y in langs])
        said, score = filters.decide(text)
        assert said == langs[int(np.argmax(exact))] and abs(score - exact.max()) < 0.05


def test_language_rows_with_clashing_columns(spark):
    rows = [(i, "der die das und" if i % 2 else "the of and to", "de" if i % 2 else "en", "k", 0.5) for i in range(60)]
    frame = spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string, lang string, lang_pred string, score double")
    assert langid.predict(frame, langid.fit(frame)).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert langid.keep(frame, langid.fit(frame)).columns == frame.columns


def plain_scan(rules, joined):
    found = [(r.priority, m.start(), -m.end(), i) for i, r in enumerate(rules) for m in re.finditer(rf"(?<!\S)(?:{r.pattern})(?!\S)", joined) if m.end() > m.start()]
    kept = []
    for priority, start, end, i in sorted(found):
        if not any((p < priority and start < b and a < -end) or (p == priority and a <= start and -end <= b) for p, a, b, _ in kept):
            kept.append((priority, start, -end, i))
    return sorted((rules[i].label, a, b, rules[i].weight) for _, a, b, i in kept)


def test_license_scan_equals_all_rules_and_all_pairs():
    rules, rng = licenses.signatures(), random.Random(6)
    pool = "licensed under the gnu general public license version 2 3 0 or any later lesser apache mit bsd clause cc by sa nc 4 all rights reserved creative commons attribution gpl v3 public domain of spdx identifier x".split()
    for _ in range(300):
        joined = " ".join(rng.choice(pool) for _ in range(40))
        assert licenses.scanner().scan(joined) == plain_scan(rules, joined)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.data())
def test_every_signature_holds_its_keyword(data):
    for rule in licenses.signatures():
        pattern = re.sub(r"\(\?<?[!=][^()]*(?:\([^()]*\)[^()]*)*\)", "", rule.pattern).replace(r"\S+", "[a-z]{1,4}").replace(r"\d", "[0-9]")
        for _ in range(3):
            text = data.draw(st.from_regex(pattern, fullmatch=True))
            assert rule.keyword in text, (rule, text)


def test_license_spans_and_long_texts(spark):
    frame = spark.createDataFrame([(1, "See: the MIT License."), (2, None), (1, "See: the MIT License.")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["label"], r["first_word"], r["last_word"]) for r in licenses.spans(frame).collect()] == [(1, "mit", 2, 3)] * 2
    n, n_base, first, last, *_ = licenses.examine(b"cc by word " * 100_000)
    assert (n, n_base, first, last) == (300_000, 100_000, 0, 299_997)
    notice = b"redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    assert licenses.examine(notice)[5] == "gpl,gpl-3.0-or-later"
    assert len(signatures.signatures()) > 200


def test_offending_spans_of_the_query_rows(spark):
    rows = [(i, f"né {i} plain words here" + (" utter dolt and fool" if i % 3 == 0 else " go on")) for i in range(90)] + [(200, None), (201, "12 3")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    assert got[200]["spans"] == got[201]["spans"] == []
    for i, text in rows[:90]:
        raw = text.encode()
        words = toxicity.tokens(raw)
        p = model.marginals(model.emissions(words), np.zeros(1, np.int64))[0]
        hot = [m.span() for m, x in zip(re.finditer(r"[^\W\d_]+", text), p) if x >= 0.5]
        assert len(words) == len(p) and all(any(s["start"] <= a and b <= s["end"] for s in got[i]["spans"]) for a, b in hot)
        assert all(text[s["start"] : s["end"]] == s["said"] for s in got[i]["spans"]) and bool(hot) == bool(got[i]["spans"])


def test_top_k_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(frame, F.col("id") % 50 == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted([(1, 1, 131072), (2, 3, 65536), (3, 2, 0), (1, 2, 131072), (2, 3, 65536), (3, 1, 0)])
    huge = spark.createDataFrame([(50, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"]) for r in topk.top_k(huge, F.col("id") % 50 == 0).orderBy("rank").collect()] == [1, 2]


def test_token_rows_of_one_id_over_many_shards(spark):
    texts = [f"text {i} of one id " * 5 for i in range(200)]
    frame = spark.createDataFrame([(7, t) for t in texts] + [(None, None), (8, "")], "doc_id bigint, text string")
    shards = tokenshards.write(frame, tokenshards.tokenizer_path(), shard_bytes=2000)
    assert 1 < shards.count() <= 12
    got = tokenshards.read(shards).orderBy("start").collect()
    whole = tokenshards.encoder(tokenshards.tokenizer_path())
    want = sorted(zlib.crc32(whole.encode(t or "") + b"\2\0\0\0") for t in [*texts, None, ""])
    assert sorted(r["ids_crc32"] for r in got) == want
    assert [r["doc_id"] for r in got] == [None] + [7] * 200 + [8]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
