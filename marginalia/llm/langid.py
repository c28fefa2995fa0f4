"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages: bit l of a slot says that language l's filter has that slot set. The AND of an
n-gram's slots is the mask of all languages that may contain it; a text's popcounts per language, corrected for each
filter's false-positive rate, decide. A language's filter holds the n-grams whose relative frequency in it is at least
``share`` of the highest one in any language, counted on a bounded sample of labelled rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; any other text gets a learned language, of
equal ones the one seen most in training, then the smaller code; with nothing to learn from all is ``und``. A null doc_id
is never learned from and has held_out false. Repeated rows stay; an empty table gives an empty result; extra columns are
ignored by ``predict`` and passed through by ``keep``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import remainder, slices, small_batches, table, unit_hash

ORDERS = (3, 4)
PIECE = 1 << 20
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case code point if a letter, else a space."""
    out = np.full(0x110000, 32, np.int64)
    for start in range(0, 0x110000, 0x10000):
        if start >= 0x40000:  # no letters are assigned there
            break
        for c in range(start, start + 0x10000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of the letters of text, runs of anything else as one space; piece by piece.

    An n-gram packs 16 bits of each character, so orders never mix; a multiply and fold then spread it.
    """
    tail = np.array([32], np.int64)
    for i in range(0, len(text), PIECE):
        points = _letters().take(np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), "<i4"))
        points = np.concatenate([tail, points, [32]] if i + PIECE >= len(text) else [tail, points])
        blank = points == 32
        points = np.delete(points, (blank[1:] & blank[:-1]).nonzero()[0] + 1)
        packed, held = points & 0xFFFF, len(tail)
        for n in range(2, max(ORDERS) + 1):
            packed = packed[:-1] << 16 | points[n - 1 :] & 0xFFFF
            if n in ORDERS:
                h = packed[max(0, held - n + 1) :].view(np.uint64) * _MIX  # those of the overlap came with the piece before
                yield h ^ h >> np.uint64(32)
        tail = points[-(max(ORDERS) - 1) :]


@dataclass
class Filters:
    """The sliced table, its hash count and the per-language false-positive rates."""

    langs: list[str]
    table: np.ndarray  # (slots, words of 64 languages)
    hashes: int
    false_rate: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram: (n,) for up to eight languages, else (n, words)."""
        sliced = self.table[:, 0] if self.table.dtype == np.uint8 else self.table
        slots, step = np.uint64(len(self.table) - 1), h >> np.uint64(40) | np.uint64(1)
        mask = sliced.take((h & slots).view(np.int64), 0)
        for i in range(1, self.hashes):
            mask &= sliced.take((h + np.uint64(i) * step & slots).view(np.int64), 0)
        return mask

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of the n-grams that it contains."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        hits, total = np.zeros(len(self.langs)), 0
        for h in grams(text):
            masks = self.masks(h)
            total += len(h)
            if self.table.dtype == np.uint8:
                hits += np.bincount(masks, minlength=256) @ _BITS[:, : len(self.langs)]
            else:
                for i in range(len(self.langs)):
                    hits[i] += int(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
        corrected = (hits - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        best = int(np.argmax(np.round(corrected, 6)))
        return self.langs[best], float(np.clip(corrected[best] / max(1, total), 0, 1))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: list[str], share: float, hashes: int = 2, slots_per_gram: int = 16) -> Filters:
    """Filters from each language's (n-gram hashes, counts); order: the languages, the preferred of equal ones first."""
    keys = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
    rate = np.zeros((len(order), len(keys)))
    for i, lang in enumerate(order):
        k, n = counts[lang]
        rate[i, np.searchsorted(keys, k)] = n / max(1, n.sum())
    member = (rate > 0) & (rate >= share * rate.max(0, initial=0))
    slots = 1 << max(10, int(np.ceil(np.log2(max(1, int(member.sum(1).max(initial=1)) * slots_per_gram)))))
    words, kind = (1, np.uint8) if len(order) <= 8 else (-(-len(order) // 64), np.uint64)
    sliced = np.zeros((slots, words), kind)
    step = keys >> np.uint64(40) | np.uint64(1)
    for i in range(len(order)):
        for j in range(hashes):
            at = ((keys + np.uint64(j) * step) & np.uint64(slots - 1))[member[i]]
            word, bit = (0, kind(1 << i)) if kind is np.uint8 else (i // 64, kind(1) << kind(i % 64))
            sliced[np.unique(at), word] |= bit
    fill = np.array([((sliced[:, 0 if kind is np.uint8 else i // 64] >> kind(i if kind is np.uint8 else i % 64)) & kind(1)).mean() for i in range(len(order))])
    return Filters(order, sliced, hashes, fill**hashes)


def fit(docs: DataFrame, max_docs_per_lang: int = 1500, min_count: int = 3, share: float = 0.25, seed: int = 11) -> Filters:
    """Learn from rows with an id whose crc32 mod 4 is not 2 and a language: about max_docs_per_lang of each, by hash."""
    small_batches(docs.sparkSession)
    rows = docs.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Filters([], np.zeros((1, 1), np.uint8), 1, np.zeros(0))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, max_docs_per_lang / n)) for k, n in sizes.items()], "_lang string, _rate double")
    drawn = rows.select("lang", "text", unit_hash("doc_id", seed=seed).alias("_u")).join(F.broadcast(rates), F.col("lang") == F.col("_lang")).filter("_u < _rate").select("lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            held: dict[str, list] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(lang, []).extend(grams(text))
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = drawn.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    got = counted.toArrow()
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    langs, keys, n = (got.column(c).to_numpy() for c in ("lang", "gram", "n"))
    return build({k: (keys[langs == k].view(np.uint64), n[langs == k]) for k in order}, order, share)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample that fit() reads

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = [shipped.value.decide(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, filters: Filters, min_score: float = 0.35) -> DataFrame:
    """The documents in a learned language, with all their columns: not und, and a score of min_score or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = (shipped.value.decide(x) for x in batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
