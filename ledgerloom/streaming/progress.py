"""Progress of jobs, retries and throttling: windows over events, and stateful streams.

A queue that visits files in turn and puts failed pages back is expressed by order keys and schedules that
follow from counts alone, so it needs no loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import THROTTLE_FAILURES, THROTTLE_SECONDS

#: Seconds before a page is tried again, the last for all further times; a request's longest pause.
RETRY_DELAYS = (30.0, 60.0, 120.0, 180.0)
LONGEST_PAUSE = 60.0
TRANSIENT = (429, 500, 502, 503, 504)


def parse_delays(text: Column | str, default: Sequence[float] = RETRY_DELAYS) -> Column:
    """Seconds of a comma list, none below zero; parts that are no numbers are skipped, the default if all are."""
    valid = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(valid) > 0, F.transform(valid, lambda x: F.greatest(F.lit(0.0), x))).otherwise(F.array(*map(F.lit, default)))


def model_candidates(primary: str, fallbacks: str) -> Column:
    """Distinct model names in order: the first choice, then a comma list."""
    names = F.filter(F.transform(F.split(F.lit(fallbacks), ","), lambda x: F.regexp_replace(F.trim(x), "^models/", "")), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(F.regexp_replace(F.lit(primary), "^models/", "")), names))


def request_pause(attempt: Column, base: float = 5.0, longest: float = LONGEST_PAUSE) -> Column:
    """Pause after the attempt-th failure (from 0): doubling, up to the longest."""
    return F.least(F.lit(longest), F.lit(base) * F.pow(F.lit(2.0), attempt))


def rotated_model(attempt: Column, models: Column) -> Column:
    return F.get(models, (attempt % F.size(models)).cast("int"))


def is_transient(status: Column) -> Column:
    return status.isin(*TRANSIENT) | status.isNull()


def retry_delay(failures: Column, delays: Sequence[float] = RETRY_DELAYS) -> Column:
    """Delay after a page's failures-th failure (from 1)."""
    return F.get(F.array(*map(F.lit, delays)), F.least(failures - 1, F.lit(len(delays) - 1)).cast("int"))


def retry_schedule(failures: DataFrame, key: str, order: Sequence[str], base: float = 5.0, delays: Sequence[float] = RETRY_DELAYS) -> DataFrame:
    """failures with attempt (from 0), pause, requeue_delay and elapsed: both schedules of a key's failures in order, and the
    seconds that its delays add up to."""
    by_key = W.partitionBy(key).orderBy(*order)
    rows = failures.withColumn("attempt", F.row_number().over(by_key) - 1)
    rows = rows.withColumn("pause", request_pause(F.col("attempt"), base)).withColumn("requeue_delay", retry_delay(F.col("attempt") + 1, delays))
    return rows.withColumn("elapsed", F.sum("requeue_delay").over(by_key.rowsBetween(W.unboundedPreceding, W.currentRow)))


def round_robin(pages: DataFrame, file_col: str, page_col: str) -> DataFrame:
    """pages with `turn`, their place when files are visited in turn, a page each."""
    order = W.partitionBy(file_col).orderBy(page_col)
    return pages.withColumn("turn", F.row_number().over(order))


def queue_order(pages: DataFrame, failures: DataFrame, file_col: str = "file_id", page_col: str = "page", delays: Sequence[float] = RETRY_DELAYS) -> DataFrame:
    """(file, page, attempt, place, not_before): attempts of a file's pages in the order of a queue that puts failures last.

    pages(file, page), failures(file, page, n): attempt k of all pages comes before attempt k + 1 of any. not_before
    is the sum of the delays that a page's failures so far have cost, in seconds."""
    tries = pages.join(failures, [file_col, page_col], "left").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(0)).cast("int") + 1)))
    steps = [sum(delays[:k]) for k in range(len(delays) + 1)]
    known = F.get(F.array(*map(F.lit, steps)), F.least(F.col("attempt") - 1, F.lit(len(delays))))
    waited = known + F.greatest(F.lit(0), F.col("attempt") - 1 - len(delays)) * F.lit(delays[-1])
    return tries.select(file_col, page_col, "attempt", F.row_number().over(W.partitionBy(file_col).orderBy("attempt", page_col)).alias("place"), waited.cast("double").alias("not_before"))


def latest_state(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last event's columns of every key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def progress_percent(phase: Column, done: Column, total: Column, bounds: dict[str, tuple[int, int]] | None = None) -> Column:
    """A job's progress: each phase fills its own part of 0 to 100."""
    bounds = bounds or {"read": (0, 90), "organise": (90, 100), "segment": (0, 30), "process": (30, 100)}
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    return F.coalesce(*[F.when(phase == k, (F.lit(lo) + share * (hi - lo)).cast("int")) for k, (lo, hi) in bounds.items()], F.lit(0))


def job_view(jobs: DataFrame, owner: str) -> DataFrame:
    """An owner's jobs as a poll shows them: the result only once they are done, the owner never."""
    return jobs.where(F.col("owner") == owner).withColumn("result", F.when(F.col("status") == "done", F.col("result"))).drop("owner", "created_at")


def throttle(events: DataFrame, key: str, ts: str, failed: Column, seconds: int = THROTTLE_SECONDS, most: int = THROTTLE_FAILURES) -> DataFrame:
    """events with `recent`, the failures of the key within the trailing seconds since its last success, and `allowed`."""
    by_time = W.partitionBy(key).orderBy(ts)
    run = events.withColumn("_run", F.sum((~failed).cast("int")).over(by_time.rangeBetween(W.unboundedPreceding, W.currentRow)))
    frame = W.partitionBy(key, "_run").orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return run.withColumn("recent", F.sum(failed.cast("int")).over(frame)).withColumn("allowed", F.col("recent") < most).drop("_run")


def stream_progress(events: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Latest progress of every job of a stream: the largest seen, with late events of up to `delay` counted."""
    return events.withWatermark(ts, delay).groupBy(key).agg(F.max("progress").alias("progress"), F.max(ts).alias("at"), F.count("*").alias("events"))


def progress_by_span(events: DataFrame, key: str, ts: str, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Progress of every job and span of a stream: the largest seen, when, and how many events, with late ones of up to
    `delay` counted. State ends with its span."""
    found = events.withWatermark(ts, delay).groupBy(key, F.window(ts, span).alias("w")).agg(F.max("progress").alias("progress"), F.max(ts).alias("at"), F.count("*").alias("events"))
    return found.select(key, F.col("w.start").alias("since"), "progress", "at", "events")


QUEUE_SCHEMA = "page_key string, kind string, at timestamp, failures int, due timestamp"
#: Milliseconds after its last failure until a page that was not tried again is given up.
GIVEN_UP = 6 * 3_600_000


def retry_queue(attempts: DataFrame, delays: Sequence[float] = RETRY_DELAYS, late: str = "10 minutes", given_up: int = GIVEN_UP) -> DataFrame:
    """What a queue of pages does, of a stream of attempts(page_key string, ts timestamp, ok boolean).

    A failed attempt is `deferred` until its delay is over; then a timer of event time makes the page `due`; one that is
    not tried again within `given_up` is `dropped`, and its state ends; a success is `completed`, and its state ends too.
    failures counts those since the last success. Timers fire as the watermark, `late` behind the newest attempt, passes
    them; between two attempts of a page they fire at the later one, so rows do not depend on how batches were cut."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, last, told = state.get if state.exists else (0, 0, False)
        out: list[tuple] = []

        def wait() -> int:
            return int(delays[min(failures, len(delays)) - 1] * 1000)

        def until(now: int) -> None:
            """What timers up to now have to say."""
            nonlocal failures, told
            if failures and not told and last + wait() <= now:
                out.append((key[0], "due", last + wait(), failures, last + wait()))
                told = True
            if failures and last + given_up <= now:
                out.append((key[0], "dropped", last + given_up, failures, None))
                failures = 0

        if state.hasTimedOut:
            until(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for at, ok in zip(rows["ts"].astype("int64") // 10 ** (3 if rows["ts"].dt.unit == "us" else 6), rows["ok"], strict=True):
                until(at)
                if ok:
                    out.append((key[0], "completed", at, failures, None))
                    failures = 0
                else:
                    failures, last, told = failures + 1, int(at), False
                    out.append((key[0], "deferred", at, failures, last + wait()))
        if failures:
            state.update((failures, last, told))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last + (given_up if told else wait())))
        elif state.exists:
            state.remove()
        if not out:
            return
        found = pd.DataFrame(out, columns=["page_key", "kind", "at", "failures", "due"])
        yield found.assign(at=pd.to_datetime(found["at"], unit="ms"), due=pd.to_datetime(found["due"], unit="ms"), failures=found["failures"].astype("int32"))

    watched = attempts.withWatermark("ts", late)
    return watched.groupBy("page_key").applyInPandasWithState(step, QUEUE_SCHEMA, "failures int, last long, told boolean", "append", "EventTimeTimeout")


def retry_stream(attempts: DataFrame, delays: Sequence[float] = RETRY_DELAYS) -> DataFrame:
    """When to try each page again, of a stream of attempts(page_key string, ts timestamp, ok boolean).

    A page's state is its number of failures; a success clears it. One row per page and batch: the failures
    so far, whether it is done, and the time of the next try."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts")
        done = False
        for ok in rows["ok"]:
            failures, done = (0, True) if ok else (failures + 1, False)
        if done:
            state.remove()
        else:
            state.update((failures,))
        wait = None if done else rows["ts"].max() + pd.Timedelta(seconds=delays[min(failures, len(delays)) - 1])
        yield pd.DataFrame({"page_key": [key[0]], "failures": [failures], "done": [done], "next_try": pd.Series([wait], dtype="datetime64[ns]")})

    return attempts.groupBy("page_key").applyInPandasWithState(step, "page_key string, failures int, done boolean, next_try timestamp", "failures int", "append", "NoTimeout")
