"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over pigeonhole shards, connected components.

Fingerprints at Hamming distance 3 or less agree on at least one of four 16-bit blocks, so the distinct fingerprints are
dealt into shards by (block, value), and each shard's rows go to one task, which builds the shard's BK-tree (children
keyed by integer distance to the parent) and looks each fingerprint up along edges within the radius. The trees travel by
shuffle, not by broadcast: a broadcast would take every fingerprint through the driver. A shard with more than
``shard_limit`` fingerprints is dealt again by blocks of its remaining bits, where the pigeonhole argument holds again,
down to a fourth level. A task returns a spanning star of each connected set of its shard, never all pairs.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; one or two words are one shingle;
equal texts share a fingerprint and so a component; a class whose ids are all null has a null component_id; repeated rows
stay separate rows; an empty table gives an empty result. Extra columns are ignored by ``link`` and passed through by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import drop_scratch, materialize, slices, table, texts, unused

#: Block widths of the four levels; every level cuts the bits that are left into four.
LEVELS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))
PIECE = 1 << 16
MASK = (1 << 64) - 1


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if set in over half of the XXH64 hashes of the word shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        part = words[i : i + PIECE + width - 1]
        m = len(part) - width + 1
        shingles = map(b" ".join, zip(*(part[j:] for j in range(width))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"), m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "fp") -> DataFrame:
    """carry columns and the fingerprint of every whole text as a signed 64-bit number."""
    fields = docs.select(*carry).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` bigint"])
    n = len(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = np.array([fingerprint(x) for x in texts(batch.column(n))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found.view(np.int64))], [*carry, name])

    return docs.select(*carry, text).mapInArrow(run, schema)


class BKTree:
    """Nodes in flat lists; children of a node by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within radius; then value joins the tree as its last node."""
        near: list[int] = []
        me = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not me:
            return near
        todo = [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                near.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].setdefault(d, me)
            if child == me:
                return near
            at = child


def stars(values: list[int], radius: int = 3) -> list[tuple[int, int]]:
    """(root, member) of every connected set of two or more distinct values; the root is the set's first value."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near_then_add(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(values[r], values[i]) for i in range(len(values)) if (r := root(i)) != i]


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """(key, rest, fp) four times: rest loses one block, whose index and value extend the key."""
    widths, parts, low = LEVELS[level], [], 0
    for b, width in enumerate(widths):
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < sum(widths) else F.lit(0).cast("bigint")
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1).cast("bigint")))
        key = F.shiftleft(F.shiftleft("key", 2).bitwiseOR(F.lit(b).cast("bigint")), width).bitwiseOR(value)
        parts.append(F.struct(key.alias("key"), rest.alias("rest"), F.col("fp").alias("fp")))
        low += width
    return rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def shards(distinct: DataFrame, shard_limit: int) -> DataFrame:
    """(key, fp): shards such that fingerprints within distance 3 share at least one."""
    rows, done = distinct.select(F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest"), "fp"), []
    for level in range(len(LEVELS)):
        dealt = _deal(rows, level)
        if level == len(LEVELS) - 1:
            done.append((dealt, level))
            break
        hot = materialize(dealt.groupBy("key").count().filter(F.col("count") > shard_limit).select("key"), "hot")
        if hot.isEmpty():
            done.append((dealt, level))
            break
        done.append((dealt.join(hot, "key", "left_anti"), level))
        rows = materialize(dealt.join(hot, "key", "left_semi"), "dealt")
    return reduce(DataFrame.unionAll, [d.select(F.struct(F.lit(level).alias("level"), "key").alias("key"), "fp") for d, level in done])


def links(distinct: DataFrame, radius: int = 3, shard_limit: int = 2048) -> DataFrame:
    """(a, b): spanning stars of the sets that each shard's BK-tree connects; the shards are whole up to radius 3."""
    if not 0 <= radius < min(map(len, LEVELS)):
        raise ValueError(f"radius {radius}: four blocks a level find all pairs only from 0 to 3")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, values, out = None, [], []
        for batch in batches:  # rows come sorted by key; a shard may span batches
            for level, key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (level, key) != last:
                    out += stars(values, radius) if len(values) > 1 else ()
                    last, values = (level, key), []
                values.append(value & MASK)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += stars(values, radius) if len(values) > 1 else ()
        yield _edges(out)

    dealt = shards(distinct, shard_limit).select("key.level", F.col("key.key").alias("key"), "fp")
    return dealt.repartition("level", "key").sortWithinPartitions("level", "key", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in one task per half million of the rows that it has at most: small rounds write few files."""
    return df.coalesce(1 + rows // 500_000)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is one node of its component, the same for all.

    Rounds of hooking every root to its smallest neighbour and pointer jumping, then contracting the edges; each round
    leaves at most half of the roots of a component, and its tables are written, so nothing but counts reaches the driver.
    """
    edges = materialize(edges, "edges")
    label = None
    while rows := edges.count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).select(F.col("a").alias("node"), "up")
        hook = materialize(_few(hook, 2 * rows), "hook")
        while True:
            one, two = (hook.select(F.col("node").alias(f"n{x}"), F.col("up").alias(f"u{x}")) for x in "12")
            jumped = hook.join(one, F.col("up") == F.col("n1")).join(two, F.col("u1") == F.col("n2")).select("node", F.col("u2").alias("up"), (F.col("u2") != F.col("up")).alias("moved"))
            jumped = materialize(_few(jumped, 2 * rows), "hook")
            done = jumped.filter("moved").isEmpty()
            drop_scratch(hook)
            hook = jumped.select("node", "up")
            if done:
                break
        to_a, to_b = (hook.select(F.col("node").alias(f"n{x}"), F.col("up").alias(f"u{x}")) for x in "ab")
        if label is None:
            label, nodes = hook.select("node", F.col("up").alias("root")), 2 * rows
        else:
            label = materialize(_few(label.join(to_a, F.col("root") == F.col("na"), "left").select("node", F.coalesce("ua", "root").alias("root")), nodes), "label")
        left = edges.join(to_a, F.col("a") == F.col("na")).select("ua", "b").distinct()
        left = left.join(to_b, F.col("b") == F.col("nb")).filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct()
        edges = materialize(_few(left, rows), "edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(prints: DataFrame, best: str, radius: int = 3, shard_limit: int = 2048) -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest value of the column best in its component."""
    groups = materialize(prints.groupBy("fp").agg(F.min(best).alias("low")), "groups")
    root = components(links(groups.select("fp"), radius, shard_limit))
    rooted = groups.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("low").alias("first")).withColumnRenamed("root", "top")
    return materialize(rooted.join(first, F.col("root") == F.col("top")).select("fp", "first"), "classes")


def link(docs: DataFrame, radius: int = 3, shard_limit: int = 2048) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    prints = materialize(fingerprints(docs), "prints")
    found = classes(prints, "doc_id", radius, shard_limit).withColumnRenamed("fp", "of")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, F.col("fp") == F.col("of")).select("doc_id", hex16.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3, shard_limit: int = 2048) -> DataFrame:
    """One document of each component, the smallest by (doc_id, text hash), with all its columns."""
    mark = unused(docs, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    prints = materialize(fingerprints(marked, ("doc_id", mark)).select(F.struct(F.col("doc_id").alias("d"), F.col(mark).alias("h")).alias("row"), "fp"), "prints")
    found = classes(prints, "row", radius, shard_limit)
    winners = found.select("first.d", "first.h").distinct()
    out = marked.join(winners, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(mark) == F.col("h")), "left_semi")
    # rows equal in id and text all match their winner; only then is there something to thin out
    if not prints.groupBy("row").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", mark])
    return out.drop(mark)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
