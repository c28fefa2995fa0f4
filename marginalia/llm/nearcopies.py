"""SimHash near copies, checked and completed by the exact Jaccard similarity of word shingles; no pair at the threshold is lost.

First come the classes of the SimHash operator (``simhash.classes``: fingerprints, pigeonhole shards, BK-trees, components): each
text is compared with one of its class on the whole shingle sets, and what proves alike is one component from there on.
No SimHash radius finds every pair at Jaccard 0.8, so the rest comes from prefixes: with all sets sorted by one order,
two sets at Jaccard ``num/den`` or more share one of the first n - ceil(num n / den) + 1 shingles of each. The order puts
shingles that are frequent in a sample last, which only lowers the number of candidates: any order finds all pairs.
Shingles that many sets still share are then known exactly, and their sets are ordered once more with these last.
The texts that share such a shingle are compared with one of them, then with more, and only those that are not in one
component yet with each other, so that a large group of near copies costs its size and not its square. Every candidate is
checked on the whole shingle sets, whose members are told apart there by 32 bits: a pair at the threshold always passes, one
a shingle below it in about one of a million.

Defined cases: null, empty and blank texts are one class; up to ``width`` words are one shingle; equal sets are one class
(sets and shingles are told apart by XXH64); letters A-Z count as a-z; repeated rows and extra columns as in ``simhash.keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, slices, texts, unused
from marginalia.llm.simhash import classes, components, fingerprint

SAMPLE, FREQUENT = 10_000, 500_000
#: Sets that a task remembers, and keys (a long each) that a broadcast may hold.
REMEMBERED, BROADCAST_ROWS = 1_000_000, 500_000
#: Sets of a shingle from which it counts as crowded; sets that all others of a shingle are compared with in each turn (0: all).
CROWD, TURNS = 16, (1, 1, 16, 0)


def shingles(raw: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the word shingles."""
    words = raw.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[j:] for j in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - width + 1))


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), by shingle, of the shingles that come twice or more in a sample of about SAMPLE texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [shingles(x, width) for x in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["g"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    counts = sample.mapInArrow(run, "g bigint").groupBy("g").count().filter("count > 1")
    top = counts.orderBy(F.desc("count"), "g").limit(FREQUENT).toArrow()
    g, n = top["g"].to_numpy().view(np.uint64), top["count"].to_numpy()
    by = np.argsort(g)
    return g[by], n[by]


def parities(found: np.ndarray) -> np.ndarray:
    """256 bits, by the last byte of the shingles: whether an odd number has it. Two sets differ in as many shingles as bits at least."""
    return np.packbits(np.bincount((found & np.uint64(255)).view(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def signatures(marked: DataFrame, mark: str, counts_of: tuple[np.ndarray, np.ndarray], width: int, num: int, den: int, simhash: bool = False) -> DataFrame:
    """row (doc_id and row hash), set (hash of the shingle set), n (its size), odd (its parities), prefix and, if asked for, fp (the SimHash) of
    every text; a set that its task has just seen gets an empty prefix and no fp, for its copies need not be found twice.
    counts_of: (shingles, counts) for the order."""
    common = marked.sparkSession.sparkContext.broadcast(counts_of)
    row_type = f"struct<d: {marked.schema['doc_id'].dataType.simpleString()}, h: bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        seen: set[int] = set()
        for batch in slices(batches, 256):
            sets, sizes, odd, prefixes, prints = [], [], [], [], []
            for raw in texts(batch.column(1)):
                found = shingles(raw, width)
                sets.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                odd.append(parities(found))
                if sets[-1] in seen:
                    prefixes.append(found[:0].view(np.int64))
                    prints.append(None)
                    continue
                if len(seen) == REMEMBERED:
                    seen.clear()
                seen.add(sets[-1])
                prints.append(int(np.uint64(fingerprint(raw)).view(np.int64)) if simhash else None)
                if len(known) and len(found):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]
                prefixes.append(found[: len(found) + 1 + -num * len(found) // den].view(np.int64))
            columns = [batch.column(0), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "set", "n", "odd", "prefix", "fp"])

    return marked.select(F.struct(F.col("doc_id").alias("d"), F.col(mark).alias("h")).alias("row"), "text").mapInArrow(run, f"row {row_type}, set bigint, n int, odd array<bigint>, prefix array<bigint>, fp bigint")


def _reach(n: Column, pos: Column, num: int, den: int) -> Column:
    """The largest size of a set that can reach the threshold with one of n shingles if their first shared one stands at pos."""
    return F.floor(F.lit(num + den) * (n - pos) / F.lit(num) - n)


def shared(prints: DataFrame, num: int, den: int) -> DataFrame:
    """(g, set, n, reach): the prefix shingles of sets that may be alike another one with the same shingle, by their sizes.

    One exchange by shingle, then running windows over its rows by size: an earlier row's reach must cover this size, or
    this reach the next size."""
    rows = prints.select("set", "n", F.posexplode("prefix").alias("pos", "g")).select("g", "set", "n", _reach(F.col("n"), F.col("pos"), num, den).cast("int").alias("reach"))
    token = Window.partitionBy("g").orderBy("n", "set")
    rows = rows.withColumn("last", F.lag("set").over(token)).filter("last is null or last <> set").drop("last")
    rows = rows.withColumn("low", F.max("reach").over(token.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", F.lead("n").over(token))
    return rows.filter("low >= n or high <= reach").drop("low", "high")


def _near(rows: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """rows joined to row keys: by broadcast while these are few, beyond BROADCAST_ROWS by shuffle."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def cut(sets: DataFrame, groups: DataFrame, marked: DataFrame, mark: str, width: int, repeated: bool) -> DataFrame:
    """(set, grams): the sorted 32-bit ends of the shingle hashes of each of the sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [np.sort(shingles(x, width).astype(np.uint32)).tobytes() for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["set", "grams"])

    of = materialize(groups.join(sets, "set", "left_semi").select("set", "low.d", "low.h"), "wanted")
    whole = _near(marked, of, (F.col(mark) == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "inner").select("set", "text")
    return materialize((whole.dropDuplicates(["set"]) if repeated else whole).mapInArrow(run, "set bigint, grams binary"), "grams")


def common_of(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share, repeats in both counted as often as in the lesser."""
    if not (x[1:] == x[:-1]).any() and not (y[1:] == y[:-1]).any():
        both = np.sort(np.concatenate([x, y]), kind="stable")
        return int((both[1:] == both[:-1]).sum())
    values, counts = np.unique(x, return_counts=True)
    others, more = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], more[j]).sum())


def alike(pairs: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = common_of(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                keep.append(den * both >= num * ((len(x) + len(y)) // 4 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (grams.select(F.col("set").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    return materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a bigint, b bigint"), "alike")


def refined(left: DataFrame, groups: DataFrame, marked: DataFrame, mark: str, known: tuple[np.ndarray, np.ndarray], width: int, num: int, den: int, repeated: bool) -> DataFrame:
    """left, with the sets of its most crowded shingles under a second order that puts these last.

    Two alike sets that meet first at a crowded shingle both have it, so both are ordered anew and meet again there; at any
    other shingle they meet as before. The list of crowded shingles is bounded; any list gives whole results."""
    sizes = left.groupBy("g").agg(F.count("*").alias("size")).filter(F.col("size") > CROWD)
    crowded = materialize(sizes.orderBy(F.desc("size"), "g").limit(FREQUENT), "crowded")
    top = crowded.toArrow()
    if not top.num_rows:
        return left
    # counts of the sample first, then the exact ones of the crowded shingles, far above them
    g = np.concatenate([top["g"].to_numpy().view(np.uint64), known[0]])
    g, first = np.unique(g, return_index=True)
    counts = np.concatenate([top["size"].to_numpy() + (1 << 40), known[1]])[first]
    sets = left.join(F.broadcast(crowded.select("g")), "g", "left_semi").select("set").distinct()
    of = materialize(groups.join(sets, "set", "left_semi").select("low.d", "low.h"), "wanted")
    again = _near(marked, of, (F.col(mark) == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    again = again.dropDuplicates([mark]) if repeated else again
    prints = materialize(signatures(again, mark, (g, counts), width, num, den), "prints")
    second = shared(prints, num, den).withColumn("g", F.xxhash64(F.lit(1), "g"))  # shingles of the two orders never mix
    return materialize(left.join(F.broadcast(crowded.select("g")), "g", "left_anti").unionByName(second), "refined")


def simhash_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): every set that the SimHash operator puts in a class with others, and the smallest set of that class."""
    prints = groups.filter("n > 0").select("fp", "set")
    found = classes(prints, "set").withColumnRenamed("fp", "of")
    both = prints.join(found, F.col("fp") == F.col("of")).filter("set <> first")
    return materialize(both.select(F.col("first").alias("a"), F.col("set").alias("b")), "pairs")


def links(left: DataFrame, groups: DataFrame, marked: DataFrame, mark: str, width: int, num: int, den: int, repeated: bool) -> DataFrame:
    """(node, root) of every set that is alike another; root is one set of its component.

    Each set of a SimHash class is compared with the smallest of its class. Then all rows of a shingle are compared with its
    smallest set, then with its largest; in crowded ones that are not settled,
    each set with 16 more at its most crowded shingle; last, what is still in different components, with each other."""
    token = Window.partitionBy("g")
    edges = tested = root = grams = dense = None
    fits = (F.col("part") != F.col("part2")) & (F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("reach2"))
    apart = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd2")[i])) for i in range(1, 4)), F.bit_count(F.col("odd")[0].bitwiseXOR(F.col("odd2")[0])))
    near = fits & ((num + den) * apart <= (den - num) * (F.col("n") + F.col("m")))

    def compare(pairs: DataFrame) -> None:
        nonlocal edges, tested, root, grams
        tested = pairs if tested is None else tested.unionAll(pairs)
        sets = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set"))).distinct()
        more = cut(sets if grams is None else sets.join(grams, "set", "left_anti"), groups, marked, mark, width, repeated)
        grams = more if grams is None else grams.unionAll(more)
        found = alike(pairs, grams, num, den)
        edges = found if edges is None else edges.unionAll(found)
        root = components(edges)

    pairs = simhash_pairs(groups)
    if not pairs.isEmpty():
        compare(pairs)
    for turn, centers in enumerate(TURNS):
        at = left.withColumn("part", F.col("set"))
        if root is not None and not turn:
            of = F.broadcast(root) if root.count() <= BROADCAST_ROWS else root
            at = left.join(of, F.col("set") == F.col("node"), "left").select("g", "set", "n", "reach", F.coalesce("root", "set").alias("part"))
        elif root is not None:  # shingles whose texts are all in one component are settled
            whole = turn <= 2 or not centers
            at = (left if whole else dense).join(root, F.col("set") == F.col("node"), "left").select("g", "set", "n", "reach", F.coalesce("root", "set").alias("part"))
            at = at.withColumn("low", F.min("part").over(token)).withColumn("high", F.max("part").over(token)).withColumn("size", F.count("*").over(token))
            at = materialize(at.filter("low <> high").drop("low", "high"), "unsettled")
            if at.isEmpty():
                if whole:
                    break
                continue
            if whole:
                left = at.drop("part", "size")
            dense = at.filter(F.col("size") > 2 * TURNS[2]).drop("part", "size")
        if turn < 2:
            both = at.withColumn("c", (F.max if turn else F.min)(F.struct("set", "n", "reach", "part")).over(token))
            both = both.select("*", F.col("c.set").alias("set2"), F.col("c.n").alias("m"), F.col("c.reach").alias("reach2"), F.col("c.part").alias("part2")).filter(fits)
        else:
            some = at
            if centers:
                some = at.filter(F.col("size") > 2 * centers).groupBy("set").agg(F.max_by(F.struct("g", "n", "reach", "part"), F.struct("size", "g")).alias("x")).select("set", "x.*")
                some = materialize(some, "some")
                if some.isEmpty():
                    continue
            some = some.join(groups.select("set", "odd"), "set")
            other = some.select("g", F.col("odd").alias("odd2"), F.col("set").alias("set2"), F.col("n").alias("m"), F.col("reach").alias("reach2"), F.col("part").alias("part2"))
            if centers:
                nth = F.row_number().over(token.orderBy(F.xxhash64(F.lit(turn), "set2")))
                both = some.join(other.withColumn("nth", nth).filter(F.col("nth") <= centers), "g").filter((F.col("set") != F.col("set2")) & near)
            else:
                both = some.join(other.withColumnRenamed("g", "g2"), (F.col("g") == F.col("g2")) & (F.col("set") < F.col("set2")) & near)
        pairs = both.select(F.least("set", "set2").alias("a"), F.greatest("set", "set2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if root is not None and pairs.isEmpty():
            continue
        compare(pairs)
    return root


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component of texts at Jaccard num/den or more, the smallest by (doc_id, row hash), with all its columns."""
    mark = unused(docs, "_row_hash")
    marked = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
    known = frequent(marked, width)
    prints = materialize(signatures(marked, mark, known, width, num, den, simhash=True), "prints")
    repeated = not prints.groupBy("row").count().filter("count > 1").isEmpty()
    groups = materialize(prints.groupBy("set").agg(F.min("row").alias("low"), F.any_value("n").alias("n"), F.any_value("odd").alias("odd"), F.min("fp").alias("fp")), "groups")
    left = refined(materialize(shared(prints, num, den), "shared"), groups, marked, mark, known, width, num, den, repeated)
    root = links(left, groups, marked, mark, width, num, den, repeated)
    rooted = groups.join(root, F.col("set") == F.col("node"), "left").select("set", "low", F.coalesce("root", "set").alias("root"))
    first = rooted.groupBy("root").agg(F.min("low").alias("first"))
    class_of = rooted.join(first, "root").select("set", "first")
    losers = materialize(prints.select("row", "set").join(class_of, "set").filter(F.col("row") != F.col("first")).select("row.d", "row.h").distinct(), "losers")
    out = _near(marked, losers, (F.col(mark) == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
    # rows equal in id and text are all kept or all lost; only then is there something to thin out
    return (out.dropDuplicates(["doc_id", mark]) if repeated else out).drop(mark)
