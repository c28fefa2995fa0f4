"""The pipeline's near copies against brute force over all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from marginalia.llm import nearcopies, simhash


def edited(words: list[str], seed: int, n: int) -> str:
    rng, out = np.random.default_rng(seed), list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{seed}x{i}"
    return " ".join(out)


def survivors(rows):
    sets = [frozenset(nearcopies.shingles((t or "").encode()).tolist()) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in group:
        before = list(group)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 5 * len(a & b) >= 4 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    return sorted((min((rows[i][0] is not None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)))


def test_near_duplicate_stage_links_all_at_jaccard_0_8(spark):
    rng = np.random.default_rng(8)
    passage = [f"common{i}" for i in range(60)]
    found = [None, "", " \n", "one two", "ONE two", "one two three four five six", "one two three four five"]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)] + passage
        found += [edited(words, 100 * base + k, k) for k in range(9)]
    chain = [f"c{i}" for i in range(320)]
    found += [" ".join(chain[i : i + 200]) for i in range(0, 120, 15)]  # each alike the next, the ends apart
    rows = [(i, t, "clash") for i, t in enumerate(found)] + [(3, "one two", "clash")]
    rows += [(None, " ".join(chain), "clash"), (None, "a text that stands alone", None), (9000, " ".join(chain[:200]), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, g string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    want = survivors(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect()) == want and got.columns == docs.columns
    assert simhash.keep_one(docs).count() > len(want)
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_values_in_common_count_with_their_repeats():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.sort(rng.integers(0, 12, rng.integers(0, 20))).astype(np.uint32) for _ in "ab")
        assert nearcopies.common_of(x, y) == sum(min((x == v).sum(), (y == v).sum()) for v in range(12))


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 40, 900):
        x, y = (np.unique(rng.integers(0, 1 << 62, n + k).astype(np.uint64)) for k in (0, 7))
        y = np.unique(np.concatenate([x[: n // 2], y]))
        bits = sum((int(a) ^ int(b)).bit_count() for a, b in zip(nearcopies.parities(x).view(np.uint64), nearcopies.parities(y).view(np.uint64)))
        assert bits <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("radius", [-1, 4])
def test_radius_beyond_the_shards_is_refused(spark, radius):
    frame = spark.createDataFrame([(0,), (1 | 1 << 16 | 1 << 32 | 1 << 48,)], "fp bigint")
    with pytest.raises(ValueError, match="radius"):
        simhash.links(frame, radius=radius)


def test_near_duplicate_stage_links_simhash_classes_that_are_alike(spark, monkeypatch):
    rng = np.random.default_rng(21)
    found = [None, "", "one two"]
    for base in range(6):
        words = [f"s{x}" for x in rng.integers(0, 5000, 600)]
        found += [" ".join(words), edited(words, 7 * base + 1, 1), edited(words, 7 * base + 2, 1), edited(words, 7 * base + 3, 200), edited(words, 7 * base + 4, 12)]
    loud = "again " * 3000  # one fingerprint, other shingle sets
    found += [loud + " ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    prints = [simhash.fingerprint((t or "").encode()) for t in found]
    sets = [set(nearcopies.shingles((t or "").encode()).tolist()) for t in found]
    close = {(i, j) for i in range(len(found)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    same = {(i, j) for i, j in close if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert (len(found) - 1, len(found) - 2) in close - same and len(same) > 5
    rows = [(i, t) for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert [(True, x) for x in whole] == survivors([(i, t, "") for i, t in rows])
    monkeypatch.setattr(nearcopies, "TURNS", ())  # the SimHash step alone
    first = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert set(whole) < first and {i for i, _ in same} - first and len(found) - 2 in first and len(found) - 1 in first
