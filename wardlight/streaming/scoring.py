"""Scoring on ingest against stored baselines, and first sightings with state."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight import fixed_values as fv
from wardlight.functions.contracts import security_errors
from wardlight.operators import detect
from wardlight.streaming.runner import run_available, write_once

DAY_US = 86_400_000_000
CHUNK = 1 << 14   # rows of a user that are thinned at a time


def score_on_ingest(events: DataFrame, baselines: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], key: str,
                    scores_path: str, quarantine_path: str, checkpoint: str):
    """Joins to the stored baselines, detectors, two outputs per batch.

    ``baselines`` gives (users, peers, known domains) and is asked in every micro-batch, so a running
    stream takes up a version as soon as it is published (``nightly.BaselineStore.current``).
    Events that break the contract go to quarantine and never stop the rest.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = detect.attach_baselines(batch.withColumn("_errors", security_errors()), *baselines(), key)
        scored = detect.orchestrate(detect.with_signals(rows, detect.behaviour_signals("engine"))).persist()
        try:
            good = scored.where(F.size("_errors") == 0).select(
                "event_id", "user_id", "occurred_at", "score", "severity", "tier", "recommendation", "signals",
                "confidence", "sample_days").withColumn("computed_at", F.current_timestamp())
            bad = scored.where(F.size("_errors") > 0).select("event_id", F.array_join("_errors", "; ").alias("error"))
            write_once(good, scores_path, batch_id)
            write_once(bad, quarantine_path, batch_id)
        finally:
            scored.unpersist()

    return run_available(events, write, checkpoint)


def thinned(us: Sequence[int], ids: Sequence[str], newest: int, window: int) -> tuple[list[int], list[str]]:
    """What waiting sightings of one token must keep: (times, ids), by time; an empty id is a time alone.

    A row with a strictly earlier sighting in the window is no first one, whatever comes later, so its id
    goes. For rows to come it matters only whether some sighting lies in the window before
    them: of a chain of sightings without a gap above the window, its start and hops of at most the window say the same.
    ``newest`` is the newest released sighting, or negative. Most lists are short, for which plain Python is faster than arrays.
    """
    times, hops = sorted(set(us)), []
    fresh = {t for earlier, t in zip([newest, *times], times) if earlier < 0 or earlier < t - window}
    for i, t in enumerate(times):
        if hops and t > hops[-1] + window and times[i - 1] > hops[-1]:
            hops.append(times[i - 1])
        if not hops or t > hops[-1] + window or (i == len(times) - 1 and t > hops[-1]):
            hops.append(t)
    kept = [(t, i) for t, i in zip(us, ids, strict=True) if t in fresh] + [(t, "") for t in hops if t not in fresh]
    kept.sort(key=itemgetter(0))
    return [t for t, _ in kept], [i for _, i in kept]


class FirstSighting(StatefulProcessor):
    """First sightings of the tokens of one (tenant, user) in event-time order.

    Sightings wait until the watermark has passed them, so the order in which they arrive
    does not matter. Waiting ones are thinned as they come, chunk by chunk; the newest
    released one of a token is a number, forgotten when the window has passed.

    All of a user's tokens are one value, so a batch asks for it once and stores it once: with few rows
    a token, the time goes into these calls. ``timer`` is the one timer that is set; one that is due too early is left.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "sightings", "timer bigint, tokens array<string>, newest array<bigint>, us array<array<bigint>>, ids array<array<string>>")

    def _stored(self) -> tuple[int | None, dict[str, tuple[int, list[int], list[str]]]]:
        """The timer, and per token its newest released sighting (or -1) and the waiting ones: (times, ids)."""
        timer, tokens, *columns = self.state.get() or (None, [], [], [], [])
        return timer, dict(zip(tokens, zip(*columns, strict=True), strict=True))

    def _keep(self, timer: int | None, tokens: dict[str, tuple[int, list[int], list[str]]]) -> None:
        """Store what waits, and a timer no later than the first waiting row, or than forgetting a newest sighting."""
        due = min(us[0] if us else newest + self.window_us for newest, us, _ in tokens.values()) // 1000 + 1
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        newest, us, ids = zip(*tokens.values(), strict=True)
        self.state.update((timer, list(tokens), list(newest), list(us), list(ids)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, tokens = self._stored()
        while chunk := list(islice(rows, CHUNK)):
            come: dict[str, list] = {}
            for row in chunk:
                come.setdefault(row.token, []).append((row.us, row.event_id))
            for token, found in come.items():
                newest, us, ids = tokens.get(token, (-1, [], []))
                tokens[token] = (newest, *thinned([*us, *(t for t, _ in found)], [*ids, *(i for _, i in found)], newest, self.window_us))
        self._keep(timer, tokens)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, tokens = self._stored()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        tenant, user = key
        out, left = [], {}
        for token, (newest, us, ids) in tokens.items():
            n = bisect_right(us, passed)
            newest = max(newest, us[n - 1]) if n else newest
            out += [Row(tenant_id=tenant, user_id=user, token=token, event_id=i) for i in ids[:n] if i != ""]
            if n < len(us) or newest + self.window_us >= passed:
                left[token] = (newest, us[n:], ids[n:])
        if left:
            self._keep(None, left)
        else:
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def first_sightings(events: DataFrame, token: str, delay: str = "1 hour",
                    days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Events whose token the user did not show in the window before, in event-time order.

    Equal to the batch form on all rows that arrive within the delay, in whatever order; a
    row comes out once the watermark has passed it. Events without a token move the watermark too.
    State is one value per (tenant, user): its tokens of the window and what waits of each, which does not grow
    with the number of sightings.
    """
    # A filter on the token alone would be moved below the watermark, which rows without one then could not move.
    us = F.when(F.col(token).isNotNull(), F.unix_micros("occurred_at")).alias("us")
    keyed = (events.withWatermark("occurred_at", delay)
             .select("tenant_id", "user_id", F.col(token).alias("token"), "event_id", us, "occurred_at")
             .where(F.col("us").isNotNull()))
    return keyed.groupBy("tenant_id", "user_id").transformWithState(
        statefulProcessor=FirstSighting(days * DAY_US),
        outputStructType="tenant_id string, user_id string, token string, event_id string",
        outputMode="Append", timeMode="EventTime")
