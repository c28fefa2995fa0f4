"""Every stage of the pipeline on nulls, empty and repeated rows, clashing columns and empty tables, against plain versions."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marginalia.llm import langid, mixing, nearcopies, pieces, quality

WORDS = {"en": "the of and to in is that it was for on as with his they at be this from have".split(), "de": "der die und das ist nicht ein mit von dem sich des auf wird war aber oder durch wenn noch".split()}


def text(i: int, lang: str) -> str:
    rng = np.random.default_rng(i)
    return " ".join(f"{w}{chr(97 + n % 26)}{chr(97 + n // 26)}" if n % 3 else w for n, w in ((int(n), str(w)) for n, w in zip(rng.integers(0, 600, 80), rng.choice(WORDS[lang], 80))))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, text(i, "de" if i % 2 else "en"), "de" if i % 2 else "en", f"s{i % 3}", 0.5, "x") for i in range(120)]
    rows += [(200 + i, text(i, "de" if i % 2 else "en") + " more", None, None, None, None) for i in range(6)]  # near copies
    rows += [rows[3], rows[3], (None, text(500, "en"), "en", "s0", 1.0, "y"), (None, None, None, None, None, None), (301, "", "en", "s1", 0.0, ""), (302, "12 34 %%", None, "s1", 0.0, ""), (303, "### " * 200, "en", "s2", 0.0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, size string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i != 303), 0) for i in (*range(120), 303)] + [(None, 1, None), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder)


def key(r):
    return (str(r["doc_id"]), r["text"], r["source"], r["size"])


def bag(frame):
    return Counter(key(r) for r in frame.collect())


def test_language_stage(spark, corpus):
    docs, folder = corpus
    got = corpus_pipeline.language(spark, docs, folder)
    filters = langid.fit(docs)
    want = Counter(key(r) for r in docs.collect() if (said := filters.decide(r["text"]))[0] != "und" and said[1] >= 0.35)
    assert got.columns == docs.columns and bag(got) == want
    assert sum(want.values()) >= 128 and not any(t in (None, "", "12 34 %%") for _, t, *_ in want)


def test_rules_stage(spark, corpus):
    docs, folder = corpus
    got = corpus_pipeline.rules(spark, docs, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {(str(r["doc_id"]), r["n_words"], r["word_chars"]) for r in quality.score(docs, labels).filter("kept").collect()}
    want = Counter(key(r) for r in docs.collect() if (str(r["doc_id"]), len((r["text"] or "").split()), sum(map(len, (r["text"] or "").split()))) in kept)
    assert got.columns == docs.columns and bag(got) == want
    assert sum(want.values()) >= 100 and ("303", "### " * 200, "s2", "") not in want


def test_near_duplicate_stage(spark, corpus):
    docs, folder = corpus
    rows = docs.collect()
    sets = [frozenset(nearcopies.shingles((r["text"] or "").encode()).tolist()) for r in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 5 * len(a & b) >= 4 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    first = lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0)
    want = sorted(min(first(i) for i in range(len(rows)) if group[i] == g) for g in set(group))
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect()) == want
    assert len(want) < len(rows) - 8


def test_mixture_stage(spark, corpus):
    docs, folder = corpus
    got = corpus_pipeline.mixture(spark, docs, folder)
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r["size"]] += r["times"]
    shown = Counter(len((r["text"] or "").split()) for r in got.collect())
    assert got.columns == docs.columns and {k: n for k, n in shown.items() if n} == {k: n for k, n in times.items() if n}


def test_encoding_stage(spark, corpus):
    docs, folder = corpus
    got = corpus_pipeline.encoding(spark, docs, folder).collect()
    lattice = pieces.Pieces(pieces.model_path(), 1)
    assert Counter((str(r["doc_id"]), lattice.decode(r["ids"])) for r in got) == Counter((str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def test_empty_tables_and_the_whole_run(spark, corpus, tmp_path):
    docs, folder = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
    whole = Counter((str(r["doc_id"]), r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == Counter((str(r["doc_id"]), r["ids_crc32"]) for r in now.collect()) and sum(whole.values()) > 50
