"""Replays of online rules over logs: pacing, caches, single flight, cooldown, backoff, budgets, progress."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.prefix import pieces


def pacing(log: DataFrame, key: str, arrival: str, tie: str, interval: float) -> DataFrame:
    """start of each request when starts within a key are interval apart: start = max(arrival, last start + interval).

    In two levels, as operators.prefix: within pieces of time first, then what the pieces before a piece leave to it."""
    inner = Window.partitionBy(key, "_piece").orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = log.withColumn("_piece", pieces(log, arrival)).withColumn("_n", F.count("*").over(inner))
    here = here.withColumn("_lead", F.col(arrival) - F.col("_n") * interval).withColumn("_late", F.max("_lead").over(inner))
    totals = here.groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_at")).agg(F.count("*").alias("_rows"), F.max("_lead").alias("_top"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    before = before.withColumn("_before", F.max(F.col("_top") - F.col("_off") * interval).over(earlier)).drop("_rows", "_top")
    rows = here.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at")))
    start = F.greatest("_before", F.col("_late") - F.col("_off") * interval) + (F.col("_off") + F.col("_n")) * interval
    return rows.withColumn("start", start).drop("_piece", "_n", "_lead", "_late", "_key", "_at", "_off", "_before")


def anchored(log: DataFrame, key: str, t: str, span: float) -> DataFrame:
    """log with hit: a row is a hit if it comes before anchor + span; a miss sets the anchor, hits do not move it.

    This is a cache with expiry from insertion, and a single flight with the load's duration as span. Rows stream by key and
    time through tasks that hold one anchor; rows without a time are never hits."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until = None, float("-inf")
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            codes, times = pd.factorize(batch[key], use_na_sentinel=False)[0], batch[t].to_numpy("float64", na_value=np.nan)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                name = batch[key].iloc[a]
                if not (a == 0 and (name == last or (pd.isna(name) and last is not None and pd.isna(last)))):
                    until = float("-inf")
                last, at = name, a + int(np.isnan(times[a:b]).sum())  # null times come first
                while at < b:
                    stop = at + int(np.searchsorted(times[at:b], until))
                    hit[at:stop] = True
                    if stop < b:
                        until = times[stop] + span
                    at = stop + 1
            yield batch.assign(hit=hit)

    return log.repartition(key).sortWithinPartitions(key, t).mapInPandas(run, f"{kinds}, hit boolean")


def cooldown(log: DataFrame, origin: str, t: str, tie: str, delay: str) -> DataFrame:
    """wait of each request: how long its origin is still closed by earlier delays, until = max(until, t + delay)."""
    before = Window.partitionBy(origin).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.col(t) + F.col(delay)).over(before)
    return log.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(until - F.col(t), F.lit(0.0))))


def backoff(attempt: Column, retry_after: Column | None = None) -> Column:
    """Delay before retry number attempt (from 1): 2 ** (attempt - 1), or Retry-After if that is longer."""
    delay = F.pow(F.lit(2.0), attempt - 1)
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after, F.lit(0.0)))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date in GMT against now; null if neither."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.greatest(F.lit(0.0), (date.cast("double") - now.cast("double")))
    return F.when(value.rlike("^[0-9]+$"), value.cast("double")).when(value.rlike(" GMT$"), seconds)


def deadline_state(started: Column, finished: Column, deadline: Column) -> Column:
    """completed, timed_out or not_started at a deadline."""
    return F.when(finished <= deadline, F.lit("completed")).when(started < deadline, F.lit("timed_out")).otherwise(F.lit("not_started"))


def retryable(status: Column) -> Column:
    return status.isin(429, 502, 503, 504)


def checked_budget(seconds: float) -> float:
    if not math.isfinite(seconds) or not 0 < seconds <= 600:
        raise ValueError("time_budget_seconds is more than 0 and at most 600")
    return float(seconds)


def within_budget(items: DataFrame, batch: str, order: str, duration: str, seconds: float, concurrency: int = 5, spent: float = 0.0) -> DataFrame:
    """items with started and finished (seconds since the batch began) and state: completed, timed_out or not_started.

    Each batch has one deadline; concurrency workers take its items in order; spent is what earlier stages took of the same
    budget, and is never regained. A batch is one caller's request, so it fits a group."""
    limit = checked_budget(seconds)
    if concurrency < 1:
        raise ValueError("concurrency is positive")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        free, begun, ended, state = [spent] * concurrency, [], [], []
        for took in rows[duration].fillna(0.0).astype(float):
            start = heapq.heappop(free)
            if start >= limit:
                heapq.heappush(free, start)
                begun.append(None)
                ended.append(None)
                state.append("not_started")
                continue
            heapq.heappush(free, start + took)
            begun.append(start)
            ended.append(start + took if start + took <= limit else None)
            state.append("completed" if start + took <= limit else "timed_out")
        return rows.assign(started=pd.Series(begun, rows.index, "float64"), finished=pd.Series(ended, rows.index, "float64"), state=state)

    return items.groupBy(batch).applyInPandas(run, f"{kinds}, started double, finished double, state string")


def budget_summary(states: DataFrame, *by: str) -> DataFrame:
    """completed, timed_out, not_started and complete of each batch."""
    counts = states.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "timed_out", "not_started")))
    return counts.withColumn("complete", (F.col("timed_out") == 0) & (F.col("not_started") == 0))


def refreshed(log: DataFrame, key: str, t: str, refresh: str, span: float) -> DataFrame:
    """log with hit, of a cache whose completed entry a row with refresh drops first: that row is a miss and anchors anew."""
    order = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = log.withColumn("_epoch", F.concat_ws(":", F.col(key).cast("string"), F.sum(F.col(refresh).cast("int")).over(order)))
    return anchored(epochs, "_epoch", t, span).drop("_epoch")


def retry_states(attempts: DataFrame, request: str, n: str, status: str, delay: str, retries: int = 1) -> DataFrame:
    """attempts (numbered from 1) with what follows each: done, retry (after its delay), or given_up."""
    again = retryable(F.col(status)) & (F.col(n) <= retries)
    return attempts.withColumn("next", F.when(again, F.lit("retry")).when(retryable(F.col(status)), F.lit("given_up")).otherwise(F.lit("done"))).withColumn("wait", F.when(again, backoff(F.col(n), F.col(delay))))


def increasing(updates: DataFrame, key: str, t: str, value: str, apart: float = 0.0) -> DataFrame:
    """Updates of progress that are shown: larger than all before in their key and, of those, the last of each span of apart seconds."""
    before = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    shown = updates.withColumn("_top", F.max(value).over(before)).filter(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")
    if not apart:
        return shown
    last = Window.partitionBy(key, "_slot").orderBy(F.desc(t))
    return shown.withColumn("_slot", F.floor(F.col(t) / apart)).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_slot", "_n")


def cache_bytes(entries: DataFrame, *fields: str) -> DataFrame:
    """entries with size: the UTF-8 bytes of their fields; nested ones count as JSON."""
    kinds = dict(entries.dtypes)
    parts = [F.octet_length(F.col(f) if kinds[f] == "string" else F.to_json(f)) for f in fields]
    return entries.withColumn("size", sum((F.coalesce(x, F.lit(0)) for x in parts), F.lit(0)).cast("bigint"))


def _replayed(log: DataFrame, group: str, order: list[str], run: Callable[[pd.DataFrame], dict[str, list]], out: str) -> DataFrame:
    """log with the columns that run gives for each group's rows in order; each group is one ordered history."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**{k: pd.Series(v, rows.index, "float64" if k in ("wait", "finished") else None) for k, v in run(rows).items()})

    return log.groupBy(group).applyInPandas(whole, f"{kinds}, {out}")


def shared_loads(log: DataFrame, key: str, t: str, took: str, ok: str, span: float = math.inf) -> DataFrame:
    """log with role, finished and done, of requests that share the load of their key.

    A request is a hit while a completed load is younger than span, a follower while another's load is under way, else an
    owner, whose load takes its own time and may fail. When a load fails its owner fails, and the first of its followers loads
    again from that moment (role retry), which the others follow."""

    def run(rows: pd.DataFrame) -> dict[str, list]:
        arrivals, times, oks = rows[t].tolist(), rows[took].astype(float).tolist(), rows[ok].astype(bool).tolist()
        role, finished, done = [""] * len(rows), [math.nan] * len(rows), [False] * len(rows)
        flight: list[int] = []  # the owner, then its followers
        end, fresh, i = math.inf, -math.inf, 0
        while i < len(rows) or flight:
            if flight and (i == len(rows) or end <= arrivals[i]):
                owner, *others = flight
                finished[owner], done[owner] = end, oks[owner]
                flight = []
                if oks[owner]:
                    fresh = end + span
                    for j in others:
                        finished[j], done[j] = end, True
                elif others:
                    flight, role[others[0]] = others, "retry"
                    end += times[others[0]]
                continue
            if arrivals[i] < fresh:
                role[i], finished[i], done[i] = "hit", arrivals[i], True
            else:
                role[i] = "follower" if flight else "owner"
                end = end if flight else arrivals[i] + times[i]
                flight.append(i)
            i += 1
        return {"role": role, "finished": finished, "done": done}

    return _replayed(log, key, [t], run, "role string, finished double, done boolean")


def cooldown_replay(log: DataFrame, process: str, t: str, origin: str, delay: str, remaining: str, most: int = 256) -> DataFrame:
    """log with wait and state (sent, or cooldown: the wait would use up the remaining time) of each request of a process.

    A delay closes its origin until then, never for less than before; while ``most`` origins are closed, further ones share one
    deadline that holds for all."""

    def run(rows: pd.DataFrame) -> dict[str, list]:
        until: dict[object, float] = {}
        shared, waits, states = 0.0, [], []
        for now, name, closed, left in zip(rows[t], rows[origin], rows[delay], rows[remaining]):
            wait = max(0.0, max(until.get(name, 0.0), shared) - now)
            waits.append(wait)
            states.append("cooldown" if wait and wait >= left else "sent")
            if states[-1] == "sent" and not pd.isna(closed):
                at = now + wait
                until = {k: x for k, x in until.items() if x > at}
                if name in until or len(until) < most:
                    until[name] = max(until.get(name, 0.0), at + closed)
                else:
                    shared = max(shared, at + closed)
        return {"wait": waits, "state": states}

    return _replayed(log, process, [t], run, "wait double, state string")


def lru_replay(log: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """log (t, ord, key, size) to t, ord, key, hit, evicted (keys dropped by this read) of a cache that loads what it lacks.

    Least recently read entries go until both limits hold; an entry larger than max_bytes is never stored; a limit of 0
    stores nothing. One cache is one ordered history: a column ``cache`` names it, and each cache is a group of its own; without
    one the whole log is one process's cache.
    """
    shared = "cache" not in log.columns
    log = log.withColumn("cache", F.lit(0)) if shared else log

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: dict[object, int] = {}  # oldest read first
        total, hits, gone = 0, [], []
        for key, size in zip(rows["key"], rows["size"]):
            hits.append(key in kept)
            out = []
            if hits[-1]:
                kept[key] = kept.pop(key)
            elif max_entries > 0 and size <= max_bytes:
                kept[key], total = size, total + size
                while len(kept) > max_entries or total > max_bytes:
                    old = next(iter(kept))
                    total -= kept.pop(old)
                    out.append(str(old))
            gone.append(out)
        return rows.assign(hit=hits, evicted=gone)[["cache", "t", "ord", "key", "hit", "evicted"]]

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    rows = log.select("cache", "t", "ord", "key", "size")
    sorted_run = lambda rows: run(rows.sort_values(["t", "ord"], kind="stable"))
    out = rows.groupBy("cache").applyInPandas(sorted_run, f"cache {kinds['cache']}, t {kinds['t']}, ord {kinds['ord']}, key {kinds['key']}, hit boolean, evicted array<string>")
    return out.drop("cache") if shared else out


def redirect_ends(starts: DataFrame, hops: DataFrame, limit: int = 5) -> DataFrame:
    """starts (url) with final_url, n_hops and state: done, or too_many_redirects beyond limit; hops (url, status, target)."""
    moved = hops.filter(F.col("status").isin(301, 302, 303, 307, 308) & F.col("target").isNotNull())
    moved = moved.groupBy(F.col("url").alias("_from")).agg(F.min("target").alias("_to"))
    rows = starts.withColumn("final_url", F.col("url")).withColumn("n_hops", F.lit(0))
    for _ in range(limit + 1):
        on = rows.join(moved, F.col("final_url") == F.col("_from"), "left")
        rows = on.withColumn("n_hops", F.col("n_hops") + F.col("_to").isNotNull().cast("int")).withColumn("final_url", F.coalesce("_to", "final_url")).drop("_from", "_to")
    return rows.withColumn("state", F.when(F.col("n_hops") > limit, F.lit("too_many_redirects")).otherwise(F.lit("done")))
