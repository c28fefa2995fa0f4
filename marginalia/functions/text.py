"""Text expressions: Unicode case folding, line splitting, match positions and preview windows, paging and versions.

All are Column expressions but the place of a match after folding, which is Arrow-batched and meets matches alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Line ends of str.splitlines().
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: White space of str.split().
WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
WINDOW, LEAD, LONG_NEEDLE = 200, 60, 140


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], str, str, str, str, str]:
    """What case folding does beyond lower-casing, by the rule of str.casefold() for every character that lower() leaves.

    Below U+0300 the few replacements and a class of them; above, characters and replacements one to one, those that become
    several characters as text for str_to_map, and a range that holds them all."""
    left = {c: c.casefold() for c in map(chr, range(0x80, 0x1FFFF)) if c == c.lower() and c != c.casefold()}
    near, far = ({c: x for c, x in left.items() if (c < "\u0300") == low} for low in (True, False))
    single = {c: x for c, x in far.items() if len(x) == 1}
    several = "\1".join(f"{c}\2{x}" for c, x in far.items() if len(x) > 1)
    return near, f"[{''.join(near)}]", "".join(single), "".join(single.values()), several, f"[{min(far)}-{max(far)}]"


def fold(text: Column | str) -> Column:
    """Full Unicode case folding, str.casefold(), by built-in functions alone; only texts that hold a character for which
    lower-casing may not be enough take the longer ways. Fold into a column once and match on that."""
    near, near_class, one, other, several, far_class = _folds()
    pairs = F.map_entries(F.str_to_map(F.lit(several), F.lit("\1"), F.lit("\2")))

    def nearer(low: Column) -> Column:
        out = low
        for c, x in near.items():
            out = F.replace(out, F.lit(c), F.lit(x))
        return F.when(low.rlike(near_class), out).otherwise(low)

    def whole(low: Column) -> Column:
        long = F.aggregate(pairs, F.translate(low, one, other), lambda so_far, p: F.replace(so_far, p["key"], p["value"]))
        return F.when(low.rlike(far_class), long).otherwise(low)

    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(let(let(F.lower(text), nearer), whole))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text as str.splitlines() gives them: no empty line after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def words(query: str) -> list[str]:
    """Distinct terms of a query by folded form, first spelling kept; at most 16 terms and 4096 characters."""
    if len(query) > 4096:
        raise ValueError("query is longer than 4096 characters")
    terms: dict[str, str] = {}
    for t in query.split():
        terms.setdefault(t.casefold(), t)
    if not 0 < len(terms) <= 16:
        raise ValueError("a query needs 1 to 16 distinct terms")
    return list(terms.values())


@F.pandas_udf(IntegerType())
def column_of(line: pd.Series, place: pd.Series) -> pd.Series:
    """1-based character of line that holds the place-th character of its folded form."""

    def find(text: str, at: int) -> int:
        for i, c in enumerate(text):
            at -= len(c.casefold())
            if at <= 0:
                return i + 1
        return len(text)

    return pd.Series([p if t.isascii() else find(t, p) for t, p in zip(line, place)], dtype="int32")


def window_start(column: Column, needle: str) -> Column:
    """0-based start of the preview of a match at a 1-based column."""
    return F.greatest(F.lit(0), column - 1 - LEAD) if len(needle) <= LONG_NEEDLE else column - 1


def preview(line: Column, start: Column) -> Column:
    return F.substring(line, start + 1, F.lit(WINDOW))


def page_slice(text: Column, start: Column | int, limit: int | None) -> Column:
    """Struct of a page: body, total_chars, start_index, end_index, next_index, truncated. None: no limit; 0: no body."""
    total = F.length(text)
    first = F.greatest(F.lit(0), F.least(F.lit(start) if isinstance(start, int) else start, total))
    end = total if limit is None else F.least(total, first + limit)
    rest = end < total
    return F.struct(
        F.substring(text, first + 1, end - first).alias("body"), total.alias("total_chars"), first.alias("start_index"), end.alias("end_index"),
        F.when(rest, end).alias("next_index"), (rest | (first > 0)).alias("truncated"),
    )


def version_id(text: Column, markdown: bool = False) -> Column:
    """SHA-256 of the whole text, with a mark in front of Markdown."""
    return F.sha2(F.concat(F.lit("markdown\0"), text) if markdown else text, 256)


def warnings_of(text: Column, title: Column) -> Column:
    """Warnings about a page's content, in a fixed order."""
    found = F.array(
        F.when(F.length(F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")) < 200, F.lit("short_content")),
        F.when(F.contains(text, F.lit("�")), F.lit("replacement_characters")),
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("missing_title")),
    )
    return F.filter(found, lambda w: w.isNotNull())


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def short(text: Column, limit: int | None = 256) -> Column:
    """White space collapsed, cut to limit characters."""
    whole = F.trim(F.regexp_replace(text, WHITE, " "))
    return whole if limit is None else F.left(whole, F.lit(limit))


def capped_metadata(title: Column, collection: Column, saved_at: Column, source_url: Column, tags: Column) -> Column:
    """Header values as they are shown: at most 32 tags of 64 characters, 2048 of a source address, 256 of others; with a flag
    for anything cut. Filters and ranks use the whole values."""
    shown = [F.left(x, F.lit(n)).alias(name) for name, x, n in (("title", title, 256), ("collection", collection, 256), ("saved_at", saved_at, 256), ("source_url", source_url, 2048))]
    some = F.transform(F.slice(tags, 1, 32), lambda t: F.left(t, F.lit(64)))
    cut = F.lit(False)
    for whole, part in ((title, shown[0]), (collection, shown[1]), (saved_at, shown[2]), (source_url, shown[3]), (tags, some)):
        cut = cut | ~whole.eqNullSafe(part)
    return F.struct(*shown, some.alias("tags"), cut.alias("truncated"))
