"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A forward Viterbi pass gives each lattice position the best score of reaching it from the start; that is the exact
heuristic of a backward A-star search from the end, which returns complete segmentations in order of score.

The vocabulary is that of a given model file; nothing is trained. Text is prepared as the model's own rule says: a leading
space, and U+2581 for each space. A character that no single piece covers is an edge of its own with a score below all
pieces, and becomes byte pieces. The lattice falls apart between two characters that stand next to each other in no
piece, so a text's segmentations are products of those of its segments; short segments are remembered, and the N best of
a text come from a second A-star search over its segments, of which only the N-1 with the smallest loss can differ.

Defined cases: a null or empty text has no pieces and score 0 and decodes to an empty text; U+2581 in a text decodes to
a space; ties of score go to the path found first, whose last pieces are longest; a text with fewer than N segmentations
returns what there is; repeated rows stay; an empty table gives an empty result; extra columns are ignored by
``encode_documents``.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import slices, small_batches, table

SPACE = "▁"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_SEGMENT = re.compile(rf"{SPACE}*[{_LETTER}]+|{SPACE}*[^{_LETTER}{SPACE}]+|{SPACE}+")
MAX_REMEMBERED, MAX_SEGMENT = 450_000, 48
#: Segmentations of each text.
N_BEST = 10


class Pieces:
    """The lattice of one model file."""

    def __init__(self, path: str, n: int = N_BEST, remembered: int = MAX_REMEMBERED) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.remembered = n, remembered
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.searched: dict[str, tuple[list[float], list[bytes], bool]] = {}
        self.searched_before: dict[str, tuple[list[float], list[bytes], bool]] = {}
        self.entry: dict[str, tuple[float, int]] = {}
        surface: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            surface.append(b"")
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.entry[piece] = (model.get_score(i), i)
                surface[i] = piece.replace(SPACE, " ").encode()
        # what a piece ends with, the pieces themselves with their score and id
        self.steps: dict[str, tuple] = dict.fromkeys((p[i:] for p in self.entry for i in range(len(p))), ()) | self.entry
        self.unknown = min(score for score, _ in self.entry.values()) - 10
        self.surface = surface
        self.lengths = np.array([len(x) for x in surface])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        pairs = {a + b for p in self.entry for a, b in zip(p, p[1:])}
        letter = re.compile(f"[{_LETTER}]")
        crosses = any(bool(letter.match(a)) != bool(letter.match(b)) and a != SPACE or (b == SPACE != a) for a, b in pairs)
        self.split = (lambda text: [text]) if crosses else _SEGMENT.findall

    def viterbi(self, text: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """The best score from the start to each position, and the edges (start, score, id; -1: an uncovered character)
        that end there, longest first."""
        best, edges, get = [0.0], [[]], self.steps.get
        for end in range(1, len(text) + 1):
            into, top = [], None
            for start in range(end - 1, -1, -1):
                x = get(text[start:end])
                if x is None:  # no piece ends so
                    break
                if x:
                    score, i = x
                    into.append((start, score, i))
                    if top is None or best[start] + score >= top:
                        top = best[start] + score
            if not into or into[0][0] != end - 1:
                into.insert(0, (end - 1, self.unknown, -1))
                if top is None or best[end - 1] + self.unknown >= top:
                    top = best[end - 1] + self.unknown
            into.reverse()
            best.append(top)
            edges.append(into)
        return best, edges

    def search(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one segment: (score, ids), best first.

        The heap holds partial paths by what they lose against the best one, which the forward scores give exactly; a path
        taken from it goes on along edges without loss down to the start, and leaves its other edges on the heap.
        """
        best, edges = self.viterbi(text)
        heap: list = [(0.0, 0, len(text), None)]
        found, order = [], 0
        while heap and len(found) < n:
            loss, _, at, path = heapq.heappop(heap)
            while at:
                follow = None
                for edge in edges[at]:
                    more = best[at] - best[edge[0]] - edge[1]
                    if follow is None and more <= 0:
                        follow = edge
                    elif n > 1:
                        order += 1
                        heapq.heappush(heap, (loss + more, order, edge[0], (edge[2], edge[0], path)))
                path = (follow[2], follow[0], path)
                at = follow[0]
            ids: list[int] = []
            while path is not None:
                i, start, path = path
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [self.byte_id[b] for b in text[start].replace(SPACE, " ").encode("utf-8", "replace")]
            found.append((best[-1] - loss, ids))
        return found

    def segment(self, text: str) -> tuple[bytes, float, float]:
        """Best ids as bytes, best score, loss of the second best (infinite if there is none).

        The search above down to its second pop: its first path follows edges without loss back from the end, and what is then
        on top of the heap, the least loss of another edge into a position of that path, exactly is the loss of the second best.
        So only the edge without loss and the least other loss of each position are kept, and no heap."""
        get, unknown, inf = self.steps.get, self.unknown, float("inf")
        best, starts, chosen, losses = [0.0], [0], [0], [inf]
        for end in range(1, len(text) + 1):
            at = end - 1
            x = get(text[at:end])
            if x:
                top, start, i = best[at] + x[0], at, x[1]
            else:
                top, start, i = best[at] + unknown, at, -1
            second = -inf
            while x is not None and at:
                at -= 1
                x = get(text[at:end])
                if x:
                    score = best[at] + x[0]
                    if score >= top:  # of equal ones the longest
                        second, top, start, i = top, score, at, x[1]
                    elif score > second:
                        second = score
            best.append(top)
            starts.append(start)
            chosen.append(i)
            losses.append(top - second)
        ids: list[int] = []
        at, loss = len(text), inf
        while at:
            loss = min(loss, losses[at])
            i, end, at = chosen[at], at, starts[at]
            ids += [i] if i >= 0 else [self.byte_id[b] for b in text[at:end].replace(SPACE, " ").encode("utf-8", "replace")][::-1]
        ids.reverse()
        return array("i", ids).tobytes(), best[-1], loss

    def segments(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """Each segment's result; what was not asked for among the last ``remembered`` / 2 fresh segments is forgotten."""
        found = list(map(self.known.get, parts))
        if None in found:
            fresh: dict[str, tuple[bytes, float, float]] = {}
            for at, p in enumerate(parts):
                if found[at] is None:
                    x = fresh.get(p)
                    if x is None:
                        x = fresh[p] = self.older.get(p) or self.segment(p)
                    found[at] = x
            self.known.update((p, x) for p, x in fresh.items() if len(p) <= MAX_SEGMENT)
            if len(self.known) > self.remembered // 2:
                self.known, self.older = {}, self.known
        return found

    def others(self, text: str) -> tuple[list[float], list[bytes], bool]:
        """What each of the n best segmentations of a segment loses, their ids as bytes, and whether all decode alike; short segments
        are remembered, ``remembered`` / 20 at most."""
        found = self.searched.get(text)
        if found is None:
            found = self.searched_before.get(text)
            if found is None:
                paths = self.search(text, self.n)
                alike = len({b"".join(map(self.surface.__getitem__, ids)) for _, ids in paths}) == 1
                found = [paths[0][0] - score for score, _ in paths], [array("i", ids).tobytes() for _, ids in paths], alike
            if len(text) <= MAX_SEGMENT:
                self.searched[text] = found
                if len(self.searched) > self.remembered // 40:
                    self.searched, self.searched_before = {}, self.searched
        return found

    def paths(self, text: str | None) -> tuple[list[tuple[float, bytes]], bool]:
        """The n best segmentations of a whole text, (score, ids as bytes), best first, and whether all decode alike."""
        if not text:
            return [(0.0, b"")], True
        parts = self.split(SPACE + text.replace(" ", SPACE))
        segments = self.segments(parts)
        total = sum([s[1] for s in segments])
        best = [s[0] for s in segments]
        out = [(total, b"".join(best))]
        if self.n == 1:
            return out, True
        # a path of the n best differs from the best one in the n - 1 segments of least loss at most; only their other
        # segmentations are searched for
        losses = [s[2] for s in segments]
        near = [i for i in heapq.nsmallest(self.n - 1, range(len(losses)), key=losses.__getitem__) if losses[i] < float("inf")]
        others = [self.others(parts[i]) for i in near]
        between, at = [], 0
        for j in sorted(range(len(near)), key=near.__getitem__):
            between.append((b"".join(best[at : near[j]]), j))
            at = near[j] + 1
        rest = b"".join(best[at:])
        # a choice's successors take one step in its last changed segment or in one behind it, so each choice comes up once
        heap = [(0.0, (0,) * len(near), 0)]
        while heap and len(out) < self.n:
            loss, choice, last = heapq.heappop(heap)
            if any(choice):
                out.append((total - loss, b"".join([x for gap, j in between for x in (gap, others[j][1][choice[j]])] + [rest])))
            for j in range(last, len(near)):
                lost, c = others[j][0], choice[j]
                if c + 1 < len(lost):
                    heapq.heappush(heap, (loss - lost[c] + lost[c + 1], choice[:j] + (c + 1,) + choice[j + 1 :], j))
        return out, all(o[2] for o in others)

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text: (score, ids), best first."""
        return [(score, np.frombuffer(ids, np.int32)) for score, ids in self.paths(text)[0]]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids, without the space that the preparation put in front."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        place = np.repeat(self.offsets[ids] - ends + lengths, lengths)
        raw = self.flat[place + np.arange(len(place))].tobytes()
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, without the space that the preparation put in front."""
        return self.decode_bytes(np.fromiter(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def pieces(path: str, n: int, remembered: int) -> Pieces:
    """One lattice a Python worker."""
    return Pieces(path, n, remembered)


def encode_documents(docs: DataFrame, model: str, n: int = N_BEST, ids: bool = False, remembered: int = MAX_REMEMBERED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, scores and crc32s of the n best, round_trip (all n decode to the text) of every whole text; with ids
    also the best path's ids.

    remembered: segments that a worker keeps (some 250 bytes each), as long as it lives."""
    extra = ", ids array<int>" if ids else ""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            lattice = pieces(model, n, remembered)
            out: dict[str, list] = {"n_pieces": [], "ids_crc32": [], "scores": [], "crc32s": [], "round_trip": [], "ids": []}
            for text in batch.column(1).to_pylist():
                paths, alike = lattice.paths(text)
                best, sums = np.frombuffer(paths[0][1], np.int32), [zlib.crc32(x) for _, x in paths]
                row = (len(best), sums[0], [s for s, _ in paths], sums, alike and lattice.decode_bytes(best) == (text or "").encode(), best)
                for column, x in zip(out.values(), row):
                    column.append(x)
            columns = [batch.column(0), pa.array(out["n_pieces"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()), pa.array(out["scores"], pa.list_(pa.float64())), pa.array(out["crc32s"], pa.list_(pa.int64())), pa.array(out["round_trip"], pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "scores", "crc32s", "round_trip"]
            if ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n_pieces bigint, ids_crc32 bigint, scores array<double>, crc32s array<bigint>, round_trip boolean{extra}")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path())
