r"""Token ids in sorted-string-table shards.

Documents are dealt by ranges of doc_id, sorted, and each task writes one shard file of the following layout to the shared
scratch folder; a document's ids end with the end id.

    block*   uint32 size, then entries, prefix-compressed against the previous key of the block and compressed (zstd):
             varint shared, varint rest, rest key bytes, varint value length, value (ids as little-endian uint32)
    index    per block: length-prefixed last key, offset and size (uint64, uint32)
    bloom    bit array over all keys, double hashing of their XXH64
    footer   index offset, bloom offset, bloom hashes, entries, tokens, magic (fixed size)

Keys are ``\x00`` for a null id, else ``\x01`` and the id as big-endian with its sign bit flipped, so that byte order is id
order; rows of one id follow each other in the order of their text within a shard, of its hash between shards. Lookup reads the footer, asks the filter, bisects the
sparse index and scans one block.

A task writes under an attempt's own name and moves the file into place, so a repeated task is harmless. Defined cases:
a null or empty text has the end id alone; a null id comes first; repeated ids are separate entries; an empty table gives
no shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import fresh_path, table

MAGIC = b"MSST0002"
CODEC = pa.Codec("zstd", 1)
FOOTER = struct.Struct("<QQIQQ8s")
#: Sizes at which a block and a shard (by the text that it encodes) are full.
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 32 << 20
#: Characters that the byte-level splitting rule surely treats as letters or digits, as marks, and as white space; no
#: apostrophe, as contractions tie a mark to the letters after it.
_WORD = "A-Za-z0-9À-ÖØ-öø-ɏ"
_MARK = "!-&(-/:-@\\[-`{-~"
_CHUNK = re.compile(rf"[ \t\n\r\x0b\x0c]*[{_WORD}]+|[ \t\n\r\x0b\x0c]*[{_MARK}]+|[ \t\n\r\x0b\x0c]+")
#: A chunk that the splitting rule leaves in one piece, so that the model's merges alone decide.
_SINGLE = re.compile(rf" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[{_MARK}]+)")
_PLAIN = re.compile(rf"[ \t\n\r\x0b\x0c{_WORD}{_MARK}]*")


class ChunkEncoder:
    """Encodes with the tokenizers library and remembers the ids of chunks that the splitting rule never joins.

    A chunk is white space with the letters or marks after it. For plain texts the cuts between chunks are cuts of the
    tokenizer's own splitting rule, so the ids of a text are those of its chunks; any other text (apostrophes, other
    scripts, special tokens) is encoded whole. At most max_chunks chunks are remembered.
    """

    def __init__(self, path: str, max_chunks: int = 1_000_000, max_chunk_chars: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.max_chunks, self.max_chars = max_chunks, max_chunk_chars

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        if not _SINGLE.fullmatch(chunk):
            return self._ids(chunk)
        ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of the whole text as little-endian uint32."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._ids(text)
        chunks = _CHUNK.findall(text)
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > self.max_chunks:
            known.clear()
        fresh = {c: self._chunk_ids(c) for c in set(chunks).difference(known)}
        known.update((c, x) for c, x in fresh.items() if len(c) <= self.max_chars)
        return b"".join([known[c] if c in known else fresh[c] for c in chunks])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker."""
    return ChunkEncoder(path)


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _bloom_bits(key: bytes, n_bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % n_bits for i in range(hashes)]


class ShardWriter:
    """Writes entries, which must come in key order, to a binary stream."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES, bits_per_key: int = 10, hashes: int = 7) -> None:
        self.stream, self.block_bytes, self.bits_per_key, self.hashes = stream, block_bytes, bits_per_key, hashes
        self.offset = self.tokens = self.entries = 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            if key < self.last:
                raise ValueError("keys out of order")
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        elif self.index and key < self.last:
            raise ValueError("keys out of order")
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.entries += 1
        self.tokens += len(value) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = struct.pack("<I", len(self.block)) + CODEC.compress(bytes(self.block), asbytes=True)
            self.stream.write(data)
            self.index.append((self.last, self.offset, len(data)))
            self.offset += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        n_bits = max(64, len(self.keys) * self.bits_per_key + 7 & ~7)
        bloom = np.zeros(n_bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_bits(k, n_bits, self.hashes)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.stream.write(index + packed + FOOTER.pack(self.offset, self.offset + len(index), self.hashes, self.entries, self.tokens, MAGIC))


class ShardReader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size() if hasattr(file, "size") else file.seek(0, 2)
        file.seek(size - FOOTER.size)
        at_index, at_bloom, self.hashes, self.entries, self.tokens, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at_index)
        index, self.bloom = file.read(at_bloom - at_index), file.read(size - FOOTER.size - at_bloom)
        self.last_keys, self.places, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        self.file.seek(self.places[i][0])
        packed, at, key = self.file.read(self.places[i][1]), 0, b""
        data = CODEC.decompress(packed[4:], struct.unpack_from("<I", packed)[0], asbytes=True)
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = _read_varint(data, at + rest)
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The values of all entries of key."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, len(self.bloom) * 8, self.hashes)):
            return []
        found = []
        for i in range(bisect_left(self.last_keys, key), len(self.places)):
            found += [v for k, v in self._block(i) if k == key]
            if self.last_keys[i] > key:
                break
        return found


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents; one row a shard: path, entries, tokens, first (its first key), start (ids before it).

    Shards get about shard_bytes of text each, so their number follows the input, and what a task holds does not."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_shards = max(1, -(-n_bytes // shard_bytes))
    folder = fresh_path(spark, "shards")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        writer = stream = None
        part = TaskContext.get().partitionId()
        name, draft = f"{root}/{part:06d}.sst", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        tail = struct.pack("<I", end_id)
        for batch in batches:
            encode = encoder(tokenizer).encode
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    stream = fs.open_output_stream(draft)
                    writer, first = ShardWriter(stream), key_of(doc_id)
                writer.add(key_of(doc_id), encode(text or "") + tail)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "first": [first], "entries": [writer.entries], "tokens": [writer.tokens]})

    ordered = docs.select("doc_id", "text").repartitionByRange(n_shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "part bigint, path string, first binary, entries bigint, tokens bigint").collect()  # a row a shard
    rows, start = [], 0
    for r in sorted(shards, key=lambda r: r["part"]):
        rows.append((folder, r["path"], bytes(r["first"]), r["entries"], r["tokens"], start))
        start += r["tokens"]
    return spark.createDataFrame(rows, "folder string, path string, first binary, entries bigint, tokens bigint, start bigint")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of the shards, from their files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, _ = pafs.FileSystem.from_uri(folder)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(path) as file:
                    for key, value in ShardReader(file):
                        for column, x in zip(out.values(), (id_of(key), start, len(value) // 4, zlib.crc32(value))):
                            column.append(x)
                        start += len(value) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out.values()], list(out))

    n = max(1, shards.count())
    return shards.select("folder", "path", "start").repartition(n, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), tokenizer_path()))
