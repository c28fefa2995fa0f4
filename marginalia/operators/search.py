"""Line and file matching with evidence, field tiers, merging of ranked lists and budgets."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.prefix import running

#: Field -> tier.
TIERS = {"title": 4, "tags": 3, "filename": 2, "text": 1}


def line_rows(files: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line (from 1), value: one row a line."""
    return files.select(key, F.posexplode(T.lines(text)).alias("pos", "value")).select(key, (F.col("pos") + 1).alias("line"), "value")


def _one(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """test as a function of one argument, as the functions over arrays want it."""
    return lambda x: test(x)


def _holds(value: Column, terms: list[str], mode: str) -> Column:
    tests = [F.coalesce(F.contains(value, F.lit(t.casefold())), F.lit(False)) for t in terms]
    return functools.reduce(Column.__and__ if mode == "all" else Column.__or__, tests)


def _matching_lines(files: DataFrame, key: str, text: Column, terms: list[str], mode: str) -> DataFrame:
    """key, line, value and folded form of the lines that hold all or any of the terms.

    A text is folded once, and cut into lines only if it holds the terms at all; folding keeps line ends. The lines come out
    of one generator, which no filter is pushed below."""

    def hits(folded: Column) -> Column:
        numbered = F.transform(T.lines(folded), lambda x, i: F.struct((i + 1).alias("line"), x.alias("folded")))
        found = F.filter(numbered, lambda x: _holds(x["folded"], terms, mode))
        with_value = T.let(T.lines(text), lambda all_: F.transform(found, lambda x: F.struct(x["line"], F.get(all_, x["line"] - 1).alias("value"), x["folded"])))
        return F.when(_holds(folded, terms, mode), with_value)

    return files.select(key, F.explode(T.let(T.fold(text), hits)).alias("x")).select(key, "x.line", "x.value", "x.folded")


def literal_lines(files: DataFrame, key: str, text: Column, needle: str) -> DataFrame:
    """Lines that hold the needle, with its column and a preview window."""
    hit = _matching_lines(files, key, text, [needle], "all").withColumn("place", F.instr("folded", needle.casefold()))
    hit = hit.withColumn("column", T.column_of("value", "place"))
    hit = hit.withColumn("text_start", T.window_start(F.col("column"), needle)).withColumn("text", T.preview(F.col("value"), F.col("text_start")))
    hit = hit.withColumn("text_end", F.col("text_start") + F.length("text"))
    return hit.withColumn("text_truncated", (F.col("text_start") > 0) | (F.col("text_end") < F.length("value"))).drop("value", "place", "folded")


def term_lines(files: DataFrame, key: str, text: Column, terms: list[str], mode: str) -> DataFrame:
    """Lines that hold all or any of the terms, with the terms found."""
    folded = F.array(*(F.lit(t.casefold()) for t in terms))
    rows = _matching_lines(files, key, text, terms, mode)
    return rows.withColumn("terms", F.filter(folded, lambda t: F.contains(F.col("folded"), t))).drop("folded")


def ranked_files(files: DataFrame, key: str, title: Column, tags: Column, filename: Column, text: Column, terms: list[str], mode: str, k: int | None, evidence: bool = False) -> DataFrame:
    """Best k files (None: all, in no order): every (or any) term in some field; tier of a file: the worst (or best) of its terms' best tiers.

    Each file is judged within its own row, without a shuffle. Adds matched_lines and the first line with a term; ties go to
    the smaller key. With evidence also the field, column and preview of the leftmost term in the first place that has one:
    the first such line, else the title, a tag or the file name.
    """
    needles = [t.casefold() for t in terms]
    blank = F.lit("")
    title, filename, text = F.coalesce(title, blank), F.coalesce(filename, blank), F.coalesce(text, blank)
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    folded = F.struct(T.fold(title).alias("title"), F.transform(tags, T.fold).alias("tags"), T.fold(filename).alias("filename"), T.fold(text).alias("text"))

    def tiers(f: Column) -> Column:
        each = []
        for t in needles:
            has = functools.partial(F.contains, right=F.lit(t))
            each.append(F.when(has(f["title"]), TIERS["title"]).when(F.exists(f["tags"], _one(has)), TIERS["tags"]).when(has(f["filename"]), TIERS["filename"]).when(has(f["text"]), TIERS["text"]))
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    def judged(f: Column) -> Column:
        enough = lambda found: F.size(found) == len(terms) if mode == "all" else F.size(found) > 0
        return T.let(tiers(f), lambda found: F.when(enough(found), lined(f, found)))

    def lined(f: Column, found: Column) -> Column:
        hits = F.when(_holds(f["text"], terms, "any"), F.transform(T.lines(f["text"]), lambda x: _holds(x, terms, "any"))).otherwise(F.array().cast("array<boolean>"))
        return T.let(hits, lambda h: F.array(result(f, found, h)))

    def result(f: Column, found: Column, hits: Column) -> Column:
        first = F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")
        rank = F.array_min(found) if mode == "all" else F.array_max(found)
        out = [F.size(found).cast("bigint").alias("n_terms"), rank.alias("priority"), F.size(F.filter(hits, lambda x: x)).cast("bigint").alias("matched_lines"), first.alias("first_line")]
        if evidence:
            shown = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
            tag = F.get(F.filter(tags, lambda x: _holds(T.fold(x), terms, "any")), F.lit(0))
            seen = F.when(first.isNotNull(), shown("text", F.get(T.lines(text), first - 1))).when(_holds(f["title"], terms, "any"), shown("title", title))
            out.append(seen.when(tag.isNotNull(), shown("tags", tag)).otherwise(shown("filename", filename)).alias("seen"))
        return F.struct(*out)

    rows = files.select(key, F.explode(T.let(folded, judged)).alias("x")).select(key, "x.*")
    if k is not None:
        rows = rows.orderBy(F.desc("priority"), key).limit(k)
    if not evidence:
        return rows
    place = F.array_min(F.filter(F.transform(F.array(*map(F.lit, needles)), lambda t: F.instr(T.fold("seen.value"), t)), lambda at: at > 0)).cast("int")
    rows = rows.withColumn("column", T.column_of("seen.value", place)).withColumn("preview", T.preview(F.col("seen.value"), F.greatest(F.lit(0), F.col("column") - 1 - T.LEAD)))
    return rows.select(key, "n_terms", "priority", "matched_lines", "first_line", F.col("seen.field").alias("field"), "column", "preview")


def interleave(candidates: DataFrame, keep: Column, limit: int) -> DataFrame:
    """Merge ranked lists (group, rank, url, title, snippet, canonical): rank by rank, engine by engine, one row a URL.

    The first row of a URL gives its title and place; all engines and pre-filter ranks stay as provenance; the first
    non-empty snippet is kept. The limit comes last, so provenance is whole.
    """
    kept = running(candidates.filter(keep).withColumn("_one", F.lit(1)), "group", "rank", F.col("_one"), "sum", "pos").drop("_one").withColumn("pos", F.col("pos").cast("int"))
    order = F.struct("pos", "group", "rank")
    merged = kept.groupBy("canonical").agg(
        F.min(order).alias("first"), F.min_by("url", order).alias("url"), F.min_by("title", order).alias("title"),
        F.min_by("snippet", F.when(F.coalesce("snippet", F.lit("")) != "", order)).alias("snippet"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "group", "rank"))), lambda x: F.struct(x["group"].alias("group"), x["rank"].alias("rank"))).alias("provenance"),
    )
    return merged.orderBy("first").limit(limit)


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def char_budget(rows: DataFrame, length: str, order: str, group: str, each: int, total: int) -> DataFrame:
    """Greedy allowance of each row within its group: at most each, at most what is left of total (0: no limit); order is a
    number that no two rows of a group share."""
    cap = F.least(F.col(length), F.lit(each)) if each else F.col(length)
    if not total:
        return rows.withColumn("allowed", cap)
    rows = running(rows.withColumn("cap", cap), group, order, F.col("cap"), "sum", "_with")
    return rows.withColumn("allowed", F.greatest(F.lit(0), F.least("cap", total - (F.col("_with") - F.col("cap"))))).drop("cap", "_with")
