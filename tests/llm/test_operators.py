"""Each corpus operator against brute force on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import zlib
from itertools import product

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, htmltext, langid, licenses, mixing, pieces, quality, simhash, tokenshards, topk, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n)))


TEXTS = [None, "", "  \n\t ", "one", "two words", sentence(1, 80), sentence(1, 80), sentence(1, 80).replace("alpha", "Alpha"), sentence(2, 20_000), "a b c " * 60, "x%% y## z&& " * 40, "line\nline\nother\n", "CC BY, cc-by 4.0 cc by\nGeneral Public License v3 all rights reserved ß ñ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i % 12, t, [None, "en", "de"][i % 3], [None, "b", "a"][i % 3], i, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, fingerprint string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_counts_and_empty(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 0), (10, 0, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    by = {(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got}
    for t in TEXTS:
        words = (t or "").encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) < 1000 else None
        if windows is not None:
            covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
            lines = [x for x in (t or "").split("\n") if x.split()]
            assert (len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)) in by
    assert quality.score(empty, labels).count() == 0 and quality.keep(docs, labels).columns == docs.columns


def test_isolation_forest_separates():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 0.01, (500, 4)), rng.uniform(0.5, 1, (20, 4))])
    scores = quality.grow(rows, 100, 128, 1).scores(rows)
    assert scores[500:].min() > np.quantile(scores[:500], 0.95)


def test_language_id(spark, empty):
    rng = np.random.default_rng(3)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    rows = [(i, make("abcdefg" if i % 2 else "mnopqré"), "xx" if i % 2 else "yy") for i in range(120)] + [(900, None, "xx"), (901, "12 %% 3", None), (None, "abc", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] in ("xx", "yy") and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["doc_id"] for r in langid.keep(docs, langid.fit(docs)).collect()} >= set(range(120))


def test_grams_do_not_depend_on_the_piece(monkeypatch):
    text = "The quick (brown) fox, 12 times; über Straße " * 9
    whole = sorted(np.concatenate(list(langid.grams(text))).tolist())
    monkeypatch.setattr(langid, "PIECE", 7)
    assert set(np.concatenate(list(langid.grams(text))).tolist()) == set(whole)


def test_crf_marginals_equal_enumeration():
    model = toxicity.Field(move=np.array([[0.5, -1.0], [-0.3, 0.8]]), start=np.array([0.2, -0.2]))
    scores, starts = np.array([0.3, -1.2, 2.0, 0.1, -0.5]), np.array([0, 3])
    want = []
    for a, b in ((0, 3), (3, 5)):
        z, one = 0.0, np.zeros(b - a)
        for y in product((0, 1), repeat=b - a):
            w = math.exp(model.start[y[0]] + sum(s * t for s, t in zip(scores[a:b], y)) + sum(model.move[i, j] for i, j in zip(y, y[1:])))
            z, one = z + w, one + w * np.array(y)
        want += list(one / z)
    assert np.allclose(model.marginals(scores, starts)[0], want)


def test_toxicity_end_to_end(spark, docs, empty):
    rows = [(i, sentence(i, 30) + (" you utter dolt and fool" if i % 3 == 0 else "")) for i in range(90)] + [(500, None), (501, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in range(90)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["predicted"] == got[501]["predicted"] == 0
    assert any("dolt" in r["said"] or "fool" in r["said"] for r in toxicity.spans(frame, model).collect())
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted((r["size"] for r in got)) == sorted(len((t or "").encode().split()) for t in TEXTS)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and {r["taken"] % max(1, r["size"]) for r in got} == {0}
    assert sum(r["times"] for r in got) == mixing.repeat_documents(docs).count()
    assert mixing.repeat_documents(docs).columns == docs.columns and mixing.mix(empty).count() == 0
    again = sorted((r["size"], r["taken"], r["target"]) for r in mixing.mix(docs).collect())
    assert again == sorted((r["size"], r["taken"], r["target"]) for r in got)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(230, 6))]
    vectors[60:130] = [vectors[0]] * 70  # ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, []), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, F.col("id") % 50 == 0).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        assert [(c, -s) for s, c in best] == [got[q, r] for r in range(1, 6)]
    assert topk.top_k(frame.limit(0), F.col("id") % 50 == 0).count() == 0


def test_simhash_links(spark, docs, empty):
    got = simhash.link(docs).collect()
    prints = [simhash.fingerprint((t or "").encode()) for t in TEXTS]
    ids = [None if i == 4 else i % 12 for i in range(len(TEXTS))]
    group = list(range(len(TEXTS)))
    for _ in group:
        for i in group:
            for j in group:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = [(ids[i], f"{prints[i]:016x}", min([ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None], default=None)) for i in range(len(ids))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
    assert simhash.keep_one(docs).count() == len(set(group)) and simhash.link(empty).count() == 0


def test_hot_shards_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, shard_limit=10)).collect()}
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    classes = lambda f: {frozenset(v for v in values if f(v) == f(x)) for x in values}
    assert classes(lambda v: root.get(v, v)) == classes(top)


def test_licenses(docs, empty):
    got = {r["labels"]: r for r in licenses.scan(docs).collect()}
    full = next(r for r in got.values() if "gpl" in r["base_labels"])
    assert full["n_base"] == 5 and full["first_word"] == 0 and full["base_labels"] == "cc-by,gpl,reserved"
    assert "cc-by-4.0" in full["labels"] and "gpl-3.0" in full["labels"] and 0 < full["score"] <= 1
    assert len(licenses.signatures()) > 200 and licenses.scan(empty).count() == 0
    kept = licenses.scanner().scan("released under the mit license")
    assert [k[0] for k in kept] == ["mit"]


def test_token_shards(spark, docs, empty, tmp_path):
    path = tokenshards.tokenizer_path()
    shards = tokenshards.write(docs, path)
    got = tokenshards.read(shards).collect()
    whole = tokenshards.encoder(path).tokenizer
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), zlib.crc32(x.tobytes())) for x in map(ids, TEXTS))
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    first = shards.orderBy("start").first()
    with pafs.FileSystem.from_uri(first["folder"])[0].open_input_file(first["path"]) as file:
        reader = tokenshards.ShardReader(file)
        for key, value in list(reader):
            assert value in reader.get(key)
        assert reader.get(tokenshards.key_of(10**12)) == []
    assert tokenshards.read(tokenshards.write(empty, path)).count() == 0


@pytest.mark.parametrize("text", ["don't I'll it's", "two   spaces\n\n new\t x \r\n", "<|endoftext|> x<|endoftext|>", "日本語 текст ÷×", " lead trail ", "%%a12b!! 3,4.5"])
def test_chunks_encode_as_the_whole(text):
    enc = tokenshards.encoder(tokenshards.tokenizer_path())
    assert enc.encode(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_html():
    title, text = htmltext.extract("<title>T &amp; U</title><p>a<p>b <b>c<ul><li>x<li>y<ol start=3><li>q</ol></ul><table><tr><th>name<th>n<tr><td>long name<td>1</table><pre>  x\n y</pre><p hidden>no</p><style>p{}</style><script>'</p>'</script>z<br>w &lt; 3")
    assert title == "T & U"
    assert text == "a\n\nb c\n\n- x\n- y\n  3. q\n\nname      | n\nlong name | 1\n\n  x\n y\n\nz\nw < 3"
    assert htmltext.extract(None) == ("", "") == htmltext.extract("")
    assert htmltext.extract("<div>" * 30_000 + "deep <b 'x")[1].startswith("deep")



def test_piece_segments():
    lattice = pieces.Pieces(pieces.model_path(), 2, remembered=8)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abtheing é\u2581\U0001f600\t9"), int(rng.integers(1, 30)))) for _ in range(300)]
    for text in texts:
        paths = lattice.search(text, 2)
        ids, score, loss = lattice.segment(text)
        assert (np.frombuffer(ids, np.int32).tolist(), score) == (paths[0][1], paths[0][0])
        assert loss == (paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf"))
        assert lattice.segments([text, text]) == [(ids, score, loss)] * 2
        assert len(lattice.known) + len(lattice.older) <= 10
    assert [lattice.segments([t])[0] for t in texts] == [lattice.segment(t) for t in texts]  # after forgetting


def test_piece_lattice_equals_enumeration(spark, docs, empty):
    lattice = pieces.Pieces(pieces.model_path(), 4)
    for text in ("▁there", "▁(a", "ab😀c", "▁▁x"):
        found: list = []

        def walk(at, score):
            if at == len(text):
                found.append(score)
                return
            ends = [e for e in range(at + 1, len(text) + 1) if text[at:e] in lattice.entry]
            for e in ends:
                walk(e, score + lattice.entry[text[at:e]][0])
            if at + 1 not in ends:
                walk(at + 1, score + lattice.unknown)

        walk(0, 0.0)
        assert [s for s, _ in lattice.search(text, 4)] == sorted(found, reverse=True)[:4]
    whole = pieces.Pieces(pieces.model_path(), 3)
    whole.split = lambda t: [t]
    parts = pieces.Pieces(pieces.model_path(), 3)
    assert [s for s, _ in whole.encode("a few words, here")] == [s for s, _ in parts.encode("a few words, here")]
    got = pieces.encode_documents(docs, pieces.model_path(), ids=True).collect()
    assert len(got) == len(TEXTS) and all(r["round_trip"] for r in got)
    assert pieces.encode_documents(empty, pieces.model_path()).count() == 0


def test_op4_returns_the_ten_best_of_every_text(spark, tmp_path):
    texts = ["the cat", "ab\U0001f600 the the", "there (a", "x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lattice = pieces.Pieces(pieces.model_path(), 1)
    rows = {r["doc_id"]: r for r in pieces.op4_sentencepiece(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
        ways: list = [[(0.0, [])]] + [[] for _ in whole]  # all segmentations that end at each place
        for end in range(1, len(whole) + 1):
            for start in range(end):
                found = lattice.entry.get(whole[start:end])
                edge = (found[0], [found[1]]) if found else (lattice.unknown, [lattice.byte_id[b] for b in whole[start:end].encode()]) if start == end - 1 else None
                ways[end] += [(score + edge[0], ids + edge[1]) for score, ids in ways[start]] if edge else []
        sums = {}
        for score, ids in ways[-1]:
            sums.setdefault(zlib.crc32(np.array(ids, "<u4").tobytes()), score)
        assert rows[i]["scores"] == sorted((score for score, _ in ways[-1]), reverse=True)[:10] and rows[i]["round_trip"]
        assert [sums[x] for x in rows[i]["crc32s"]] == rows[i]["scores"] and len(set(rows[i]["crc32s"])) == len(rows[i]["scores"])
    assert [len(rows[i]["scores"]) for i in (0, 1, 4, 5)] == [10, 10, 1, 1]


def test_scratch_follows_the_session(spark):
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    assert common.scratch_dir(spark) == set_dir.rstrip("/") if set_dir else common.scratch_dir(spark).startswith("file:")
