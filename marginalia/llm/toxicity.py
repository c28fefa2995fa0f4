"""Toxicity: a linear-chain conditional random field over tokens, with states clean and toxic.

Training labels exist per document, so tokens get theirs by distant supervision: in toxic training documents, a token with
a word or prefix feature that is far more frequent in toxic documents is toxic; every token of a clean document is clean.
The field (feature weights of the toxic state, transitions, start) is fitted by its exact gradient. Forward-backward
marginals of every token of the whole text then aggregate to a document score through a small logistic model, and to the
character offsets of offending spans.

Both passes run over all tokens of a batch at once: the recursions are products of 2x2 matrices, cut into columns whose
products are scanned first; a document's first token carries a rank-one matrix, which resets the chain.

Defined cases: a null, empty or letterless text has no tokens and gets the score of a text without toxic tokens; with no
training rows of both labels every score is 0 and no span is found; repeated rows stay; an empty table gives an empty result; extra columns are
ignored. Labels with several rows for one document count as toxic if any says so.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import remainder, slices, table, texts, unit_hash

_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_TOKEN = re.compile(rb"[a-zA-Z\x80-\xff]+")
PREFIXES = (4, 5, 6, 7, 8)
MAX_REMEMBERED = 1_000_000


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    return raw.decode("utf-8", "replace").lower().encode().translate(_BLANK).split()


def features(token: bytes) -> list[bytes]:
    """The word itself and its prefixes of some lengths in characters (marked by a trailing star)."""
    word = token.decode("utf-8", "replace")
    return [token, *(word[:n].encode() + b"*" for n in PREFIXES if len(word) >= n)]


def head(word: bytes) -> str:
    """The first characters, as many as the shortest prefix feature has."""
    return word.decode("utf-8", "replace")[: PREFIXES[0]]


def _scan(e1: np.ndarray, reset: np.ndarray, move: np.ndarray, start: np.ndarray, length: int = 48) -> np.ndarray:
    """Share of state 1 in the normalized forward vector at each token: diag(1, e1) move' a[t-1], or diag(1, e1) start at resets."""
    n = len(e1)
    if not n:
        return np.zeros(0)
    width = -(-n // length)
    pad = width * length - n
    e1, reset = (np.ascontiguousarray(np.pad(x, (0, pad), constant_values=v).reshape(width, length).T) for x, v in ((e1, 1.0), (reset, False)))
    # k[i][j]: from state i to state j with the token's own score
    k00, k10 = np.where(reset, start[0], move[0, 0]), np.where(reset, start[0], move[1, 0])
    k01, k11 = np.where(reset, start[1], move[0, 1]) * e1, np.where(reset, start[1], move[1, 1]) * e1
    # (p, q) and (r, s): where states 0 and 1 at the column's entry lead
    p, q, r, s = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(length):
        p, q, r, s = p * k00[t] + q * k10[t], p * k01[t] + q * k11[t], r * k00[t] + s * k10[t], r * k01[t] + s * k11[t]
        if t % 4 == 3:
            norm = 1 / (p + q + r + s)
            p, q, r, s = p * norm, q * norm, r * norm, s * norm
    entry, share = [], 0.5
    for a, b, c, d in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist()):
        entry.append(share)
        x, y = a + share * (c - a), b + share * (d - b)
        share = y / (x + y)
    got, one = np.empty((length, width)), np.array(entry)
    for t in range(length):
        zero = 1 - one
        a, b = zero * k00[t] + one * k10[t], zero * k01[t] + one * k11[t]
        one = np.divide(b, a + b, out=got[t])
    return got.T.ravel()[:n]


@dataclass
class Field:
    """Weights of the toxic state by feature, 2x2 transition scores, start scores, and the document model."""

    weights: dict[bytes, float] = field(default_factory=dict)
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    bias: float = 0.0
    document: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.known: dict[bytes, float] = {}
        self.heads = {head(f.rstrip(b"*")) for f in self.weights}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Score of the toxic state over the clean one for each token."""
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            pass
        if len(known) > MAX_REMEMBERED:
            known.clear()
        weights, heads, bias = self.weights, self.heads, self.bias
        for w in set(words).difference(known):  # a word with another head has no weighted feature
            known[w] = bias + sum(weights.get(f, 0.0) for f in features(w)) if head(w) in heads else bias
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each token, with the forward and backward shares; starts: the first tokens of documents."""
        n = len(scores)
        reset, last = np.zeros(n, bool), np.zeros(n, bool)
        reset[starts] = True
        last[np.append(starts[1:], n) - 1] = True
        e1 = np.exp(np.clip(scores, -30, 30))
        move = np.exp(self.move)
        ahead = _scan(e1, reset, move, np.exp(self.start))
        behind = _scan(e1[::-1], last[::-1], move.T, np.ones(2))[::-1]
        one, zero = ahead * behind / e1, (1 - ahead) * (1 - behind)
        return one / (one + zero), ahead, behind

    def documents(self, raws: list[bytes], threshold: float = 0.5) -> tuple[list[float], list[list[Span]]]:
        """Score and offending spans of each text."""
        if self.document is None:
            return [0.0] * len(raws), [[] for _ in raws]
        words = [tokens(r) for r in raws]
        sizes = np.array([len(w) for w in words])
        flat = self.emissions([w for ws in words for w in ws])
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[sizes > 0]
        p = self.marginals(flat, starts)[0] if len(flat) else np.zeros(0)
        x = aggregates(p, sizes)
        found: list[list[Span]] = [[] for _ in raws]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= threshold), "right")):
            found[i] = spans_of(raws[i], p[ends[i] - sizes[i] : ends[i]], threshold)
        return (1 / (1 + np.exp(-np.clip(x @ self.document, -40, 40)))).tolist(), found


Span = tuple[int, int, str, float]


def spans_of(raw: bytes, p: np.ndarray, threshold: float) -> list[Span]:
    """(start, end, text, peak marginal) of each run of tokens with a marginal of threshold or more; offsets in code points."""
    hot = np.flatnonzero(np.diff(np.concatenate([[False], p >= threshold, [False]]).astype(np.int8)))
    places = [m.span() for m in _TOKEN.finditer(raw)]
    out, at, chars = [], 0, 0
    for i, j in zip(hot[::2].tolist(), hot[1::2].tolist()):
        a, b = places[i][0], places[j - 1][1]
        chars += len(raw[at:a].decode("utf-8", "replace"))
        said = raw[a:b].decode("utf-8", "replace")
        out.append((chars, chars + len(said), said, float(p[i:j].max())))
        at, chars = b, chars + len(said)
    return out


def aggregates(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, logit of the largest marginal, log of the expected toxic tokens, their share."""
    top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    if len(starts):
        top[full], total[full] = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.ones(len(sizes)), np.log(top / (1 - top)) / 4, np.log1p(total), total / np.maximum(1, sizes)])


def distinct_documents(docs: list[np.ndarray]) -> list[int]:
    """Indexes of documents (word numbers) that share no two of four minimum 5-word hashes with an earlier one: copies teach nothing new."""
    seen, out = set(), []
    for i, ids in enumerate(docs):
        width, wide = min(5, len(ids)), ids.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(ids) - width + 1, np.uint64)
        for j in range(width):
            h = (h + wide[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        spread = [int((h * np.uint64(m)).min(initial=0xFFFFFFFFFFFFFFFF)) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        pairs = {(a, b, spread[a], spread[b]) for a in range(4) for b in range(a)}
        if not pairs & seen:
            out.append(i)
        seen |= pairs
    return out


def train(raws: Iterable[bytes], toxic: list[bool], prior: float, min_docs: int = 4, min_ratio: float = 6.0, steps: int = 40, l2: float = 1e-3) -> Field:
    """Fit the field and the document model; prior: the share of toxic documents where it is to be used."""
    vocabulary: dict[bytes, int] = {}
    words = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens(r)), np.int32) for r in raws]
    keep = [i for i in distinct_documents(words) if len(words[i])]
    words, toxic = [words[i] for i in keep], [toxic[i] for i in keep]
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    if not n_toxic or not n_clean:
        return Field()
    # features that any toxic document has, numbered; (rows, cols): word by feature
    in_toxic = np.zeros(len(vocabulary), bool)
    for ids, t in zip(words, toxic):
        if t:
            in_toxic[ids] = True
    number: dict[bytes, int] = {}
    heads_of, rows, cols = [], array("i"), array("i")
    for word, bad in zip(vocabulary, in_toxic):
        if bad:
            for f in features(word):
                number.setdefault(f, len(number))
    for w, word in enumerate(vocabulary):
        heads_of.append(head(word))
        for f in features(word):
            if f in number:
                rows.append(w)
                cols.append(number[f])
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    first = np.searchsorted(rows, np.arange(len(vocabulary) + 1))
    found = np.zeros((2, len(number)))
    for ids, t in zip(words, toxic):
        own = np.unique(ids)
        found[int(t), np.unique(np.concatenate([cols[first[w] : first[w + 1]] for w in own]))] += 1
    marks = (found[1] >= min_docs) & (found[1] / n_toxic >= min_ratio * (found[0] + 0.5) / n_clean)
    # the model's features: the marks, and those of words that begin like a mark, which tell clean words from toxic ones
    names = list(number)
    heads = {head(names[f].rstrip(b"*")) for f in np.flatnonzero(marks)}
    like = np.array([h in heads for h in heads_of])
    used = marks.copy()
    used[cols[like[rows]]] = True
    used &= marks | ((found[0] > 0) & (found[1] > 0))
    marked = np.bincount(rows, marks[cols], len(vocabulary)) > 0
    names = [f for f, u in zip(names, used) if u]
    place = np.cumsum(used) - 1
    rows, cols = rows[used[cols]], place[cols[used[cols]]]
    n_words = len(vocabulary)
    del vocabulary, number, heads_of
    ids, sizes = np.concatenate(words), np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    y = (marked[ids] & np.repeat(np.array(toxic), sizes)).astype(np.float64)
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen_move = np.array([[((1 - y[at - 1]) * (1 - y[at])).sum(), ((1 - y[at - 1]) * y[at]).sum()], [(y[at - 1] * (1 - y[at])).sum(), (y[at - 1] * y[at]).sum()]])
    seen_start = np.array([(1 - y[starts]).sum(), y[starts].sum()])
    seen_word = np.bincount(ids, y, n_words)
    model = Field()
    w, bias = np.zeros(len(names)), 0.0
    slots = [np.zeros_like(x) for x in (w, np.zeros(1), model.move, model.start)]
    speed = [np.zeros_like(x) for x in slots]
    scale = 1.0 / max(1.0, y.sum())
    for step in range(1, steps + 1):
        by_word = bias + np.bincount(rows, w[cols], n_words)
        scores = by_word[ids]
        p, ahead, behind = model.marginals(scores, starts)
        b0, b1, a1 = 1 - behind[at], behind[at], ahead[at - 1]
        m = np.exp(model.move)
        joint = [(1 - a1) * m[0, 0] * b0, (1 - a1) * m[0, 1] * b1, a1 * m[1, 0] * b0, a1 * m[1, 1] * b1]
        total = sum(joint)
        hoped_move = np.array([(j / total).sum() for j in joint]).reshape(2, 2)
        gap = seen_word - np.bincount(ids, p, n_words)
        slope = [np.bincount(cols, gap[rows], len(names)) * scale - l2 * w, np.array([gap.sum() * scale - l2 * bias]), (seen_move - hoped_move) * scale - l2 * model.move, (seen_start - np.array([(1 - p[starts]).sum(), p[starts].sum()])) * scale - l2 * model.start]
        change = []
        for i, g in enumerate(slope):  # Adam
            slots[i] = 0.9 * slots[i] + 0.1 * g
            speed[i] = 0.99 * speed[i] + 0.01 * g * g
            change.append(0.3 * (slots[i] / (1 - 0.9**step)) / (np.sqrt(speed[i] / (1 - 0.99**step)) + 1e-8))
        w, bias = w + change[0], bias + change[1][0]
        model.move, model.start = model.move + change[2], model.start + change[3]
    model = Field({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, model.move, model.start, float(bias))
    p = model.marginals((bias + np.bincount(rows, w[cols], n_words))[ids], starts)[0]
    x, t = aggregates(p, sizes), np.array(toxic, np.float64)
    importance = np.where(t > 0, prior / n_toxic, (1 - prior) / n_clean) * len(t)
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a weighted, lightly regularized logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (importance * (t - q)) - 0.5 * beta
        h = (x * (importance * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, g)
    model.document = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 2000, seed: int = 5) -> Field:
    """Train on about max_toxic and max_clean labelled documents, drawn by hash, whose crc32(doc_id) mod 5 is not 0."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        return Field()
    rate = F.when(F.col("_toxic") == 1, min(1.0, max_toxic / sizes[1])).otherwise(min(1.0, max_clean / sizes[0]))
    drawn = known.filter(unit_hash("_id", seed=seed) < rate).select("_id", "_toxic")  # max_toxic + max_clean ids expected: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "_toxic", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(texts(pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string())), [x == 1 for x in rows.column("_toxic").to_pylist()], sizes[1] / (sizes[0] + sizes[1]))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("said", pa.string()), ("peak", pa.float64())]))


def score(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans (start, end in code points, said, peak) of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that fit() reads

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            scores, spans = shipped.value.documents(texts(batch.column(2)), threshold)
            found = np.array(scores)
            shown = pa.array([[dict(zip(("start", "end", "said", "peak"), x)) for x in row] for row in spans], SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), pa.array((found >= 0.5).astype(np.int32)), shown], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint, said: string, peak: double>>")


def spans(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), text and peak marginal of each run of tokens with a marginal of threshold or more."""
    return score(docs, model, threshold).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
