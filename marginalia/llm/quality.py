"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

Each text gives rule statistics (exact counts over the whole text). Fixed base rules reject some documents; the
others get the forest's anomaly score 2 ** (-mean path length / c(psi)) and go when it exceeds a threshold that
separates labelled good from labelled bad documents.

Defined cases: a null or blank text has zero words and fails the base rules; an empty table gives an empty result;
with no labelled rows the threshold is ``default_threshold``; with no row that passes the base rules there is no forest,
and the base rules alone decide. Rows with equal doc_id are separate rows. Extra columns are ignored by ``score``
and passed through by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import WHITE, materialize, slices, table, texts

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Repeated lines show in repeat_share already, weighted by their words.
FEATURES = ["symbol_share", "repeat_share", "upper_share", "mark_share"]
BINS = 4096
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.")
_NOT_UPPER = bytes(c for c in range(128) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
_NOT_MARKS = bytes(c for c in range(256) if c not in _MARKS)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of width words that the text holds twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    hot = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(hot), 1)
    np.add.at(covered, np.flatnonzero(hot) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(raw: bytes) -> tuple:
    """The five base counts and the four features of one text."""
    words = raw.split()
    n = len(words)
    text = raw.decode("utf-8", "replace")
    n_chars = len(text)
    white = sum(map(raw.count, (c.encode() for c in WHITE)))
    symbols = sum(map(raw.count, (c.encode() for c in SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = len(raw.translate(None, _NOT_LETTER))
    upper = len(raw.translate(None, _NOT_UPPER)) - (len(raw) - len(raw.translate(None, bytes(range(128, 256)))))
    marks = len(raw.translate(None, _NOT_MARKS))
    features = (symbols / max(1, n_chars), repeat / max(1, n), max(0, upper) / max(1, letters), marks / max(1, n_chars))
    return (n, n_chars - white, symbols, dup, repeat, *features)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), split value, left and right child, depth adjusted for leaf size."""

    feature: list[np.ndarray]
    split: list[np.ndarray]
    child: list[np.ndarray]
    depth: list[np.ndarray]
    norm: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, split, child, depth in zip(self.feature, self.split, self.child, self.depth):
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[np.arange(len(rows)), np.maximum(f, 0)] >= split[at]
                at = np.where(inner, child[at, right.astype(np.int64)], at)
            total += depth[at]
        return np.exp2(-total / len(self.feature) / self.norm) if self.feature else np.zeros(len(rows))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, n_trees: int, psi: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    psi = min(psi, len(rows))
    limit = math.ceil(math.log2(max(2, psi)))
    forest = Forest([], [], [], [], max(expected_path(psi), 1e-9))
    for _ in range(n_trees if psi > 1 else 0):
        feature, split, child, depth = [], [], [], []
        todo = [(rows[rng.choice(len(rows), psi, replace=False)], 0, None)]
        while todo:
            points, level, parent = todo.pop()
            me = len(feature)
            if parent:
                child[parent[0]][parent[1]] = me
            low, high = points.min(0), points.max(0)
            varied = np.flatnonzero(high > low)
            child.append([me, me])
            if level >= limit or len(points) <= 1 or not len(varied):
                feature.append(-1)
                split.append(0.0)
                depth.append(level + expected_path(len(points)))
                continue
            f = int(rng.choice(varied))
            at = rng.uniform(low[f], high[f])
            at = at if at > low[f] else high[f]
            feature.append(f)
            split.append(at)
            depth.append(0.0)
            right = points[:, f] >= at
            todo += [(points[right], level + 1, (me, 1)), (points[~right], level + 1, (me, 0))]
        for name, values in (("feature", feature), ("split", split), ("child", child), ("depth", depth)):
            getattr(forest, name).append(np.array(values))
    return forest


def rule_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, base counts and features of every whole text."""
    fields = [f for f in docs.select(*carry).schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    n = len(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [statistics(x) for x in texts(batch.column(n))]
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < len(COUNTS) else pa.float64()) for i in range(len(COUNTS) + len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*carry, *COUNTS, *FEATURES])

    return docs.select(*carry, text).mapInArrow(run, schema)


@dataclass
class Model:
    forest: Forest
    threshold: float


def fit(stats: DataFrame, labels: DataFrame, n_trees: int = 100, psi: int = 256, max_fit_rows: int = 20_000, false_reject_cost: float = 5.0, default_threshold: float = 0.6, seed: int = 7) -> Model:
    """Grow the forest on at most about max_fit_rows rows drawn by hash; calibrate the threshold on all labelled rows.

    The threshold maximises (share of bad documents rejected) - false_reject_cost * (share of good ones rejected); of equal
    ones the highest. ``stats`` is read several times: pass a written table.
    """
    passed = stats.filter((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    total = passed.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", *COUNTS), F.lit(1 << 30))
    sample = passed.filter(draw < int(min(1.0, max_fit_rows / max(1, total)) * (1 << 30))).select(draw.alias("_h"), *FEATURES).toPandas()
    sample = sample.sort_values(["_h", *FEATURES])[FEATURES].to_numpy(np.float64)
    forest = grow(sample, n_trees, psi, seed)
    # labelled documents are joined by id, scored, and only counts by score bin and label come back
    labelled = labels.filter("quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    known = passed.select("doc_id", *FEATURES).join(labelled, F.col("doc_id") == F.col("_id")).select("_quality", *FEATURES)
    counts = np.zeros((BINS + 1, 2))
    for r in scored(known, forest, ("_quality",)).groupBy("_quality", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).count().collect():
        counts[min(max(r["bin"], 0), BINS), int(r["_quality"] > 0)] += r["count"]
    if not counts.any():
        return Model(forest, default_threshold)
    above = counts[::-1].cumsum(0)[::-1] / np.maximum(1, counts.sum(0))  # shares with a bin at or above each
    gain = above[:, 0] - false_reject_cost * above[:, 1]
    best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
    return Model(forest, best / BINS if gain.max() > 0 else 1.01)


def scored(stats: DataFrame, forest: Forest, carry: tuple[str, ...]) -> DataFrame:
    """carry columns and the anomaly score of every row of stats."""
    shipped = stats.sparkSession.sparkContext.broadcast(forest)  # n_trees * psi nodes at most
    fields = stats.select(*carry).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "anomaly double"])
    n = len(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(shipped.value.scores(rows))], [*carry, "anomaly"])

    return stats.select(*carry, *FEATURES).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, base_failed, kept, anomaly for every document."""
    stats = materialize(rule_statistics(docs), "quality")
    model = fit(stats, labels, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored(stats, model.forest, ("doc_id", *COUNTS)).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < F.lit(model.threshold))).alias("kept"), "anomaly")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    model = fit(materialize(rule_statistics(docs), "quality"), labels, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = shipped.value.forest, shipped.value.threshold
        for batch in slices(batches, 512):
            rows = [statistics(x) for x in texts(batch.column(at))]
            passed = np.array([not base_failed(r[0], r[4]) for r in rows])
            passed &= forest.scores(np.array([r[5:] for r in rows])) < threshold
            yield batch.filter(pa.array(passed))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
