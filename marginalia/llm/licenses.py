"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; signatures are regular expressions over the
words joined by single spaces, so that line breaks and marks never matter. A signature runs only if its keyword stands in
the text (one Aho-Corasick pass decides for all). Detections are resolved in order of priority: one that overlaps a kept
detection of higher priority is dropped, and so is one that lies inside another of its own. The base phrases are searched
beside them, and their labels stay.

Defined cases: a null, empty or wordless text has zero words, null positions, empty labels and score 0; overlapping
places of a phrase all count; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import slices, table, texts
from marginalia.llm.signatures import Rule, signatures

_BLANK = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
#: The phrases of the contract with their labels.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}


class Scanner:
    """The compiled rules and the automaton over their keywords."""

    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = rules
        self.compiled = [re.compile(rf"(?<!\S)(?:{r.pattern})(?!\S)") for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, indexes in by_keyword.items():
            self.automaton.add_word(keyword, indexes)
        self.automaton.make_automaton()

    def scan(self, joined: str) -> list[tuple[str, int, int, float]]:
        """(label, start, end, weight) of the kept detections, in characters of the joined words."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in {i for _, indexes in self.automaton.iter(joined) for i in indexes}:
            found.setdefault(self.rules[i].priority, []).extend((m.start(), -m.end(), i) for m in self.compiled[i].finditer(joined) if m.end() > m.start())
        return sorted((self.rules[i].label, a, b, self.rules[i].weight) for a, b, i in resolve(found))


def resolve(found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the kept ones of {priority: [(start, -end, rule)]}.

    A detection goes if it overlaps a kept one of higher priority, or lies inside one of its own priority (of equal places
    the first rule's stays). Sorted places and bisection keep this linear but for the sorting.
    """
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []  # disjoint places that higher priorities cover
    ends: list[int] = []
    for priority in sorted(found):
        reach, level = -1, []
        for start, end, i in sorted(found[priority]):
            end = -end
            at = bisect_left(ends, start + 1)  # the first covered place that ends after start
            if at < len(starts) and starts[at] < end or end <= reach:
                continue
            reach = max(reach, end)
            level.append((start, end, i))
        kept += level
        covered = sorted([*zip(starts, ends), *((a, b) for a, b, _ in level)])
        starts, ends = [], []
        for a, b in covered:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
    return kept


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(signatures())


def normalize(raw: bytes) -> list[bytes]:
    """The words of a text."""
    return raw.lower().translate(_BLANK).split()


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase in space-joined words."""
    padded, found = b" " + joined + b" ", []
    for phrase, label in BASE.items():
        word = last = 0
        at = padded.find(b" " + phrase + b" ")
        while at >= 0:
            word, last = word + padded.count(b" ", last, at), at
            found.append((word, label))
            at = padded.find(b" " + phrase + b" ", at + 1)
    return sorted(found)


def examine(raw: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = normalize(raw)
    joined = b" ".join(words)
    places = base_places(joined)
    labels = {label for _, label in places}
    detections = scanner().scan(joined.decode("utf-8", "replace")) if words else []
    doubt = 1.0
    for *_, weight in detections:
        doubt *= 1 - weight
    if labels:
        doubt *= 0.5
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(labels)), ",".join(sorted(labels | {d[0] for d in detections})), 1 - doubt)


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the findings of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [examine(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_OUT))], ["doc_id", *(n for n, _ in _OUT)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, label, first and last word (from 0) and weight of every kept detection of the rules."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                joined = b" ".join(normalize(raw)).decode("utf-8", "replace")
                blanks = [m.start() for m in re.finditer(" ", joined)]
                out += [(doc_id, label, bisect_left(blanks, a), bisect_left(blanks, b), w) for label, a, b, w in scanner().scan(joined)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "label", "first_word", "last_word", "weight"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, label string, first_word bigint, last_word bigint, weight double")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
