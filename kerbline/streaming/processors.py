"""Keyed state of the streams: what a bay, a frame, a drone or a sender remembers between batches.

State lives in Spark's state store below the stream's checkpoint; a batch reads and writes the keys it touches and nothing else.
Times are microseconds (milliseconds where timers are concerned) since 1970.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICT = "bay_id string, seq bigint, change_no bigint, occupied boolean, confidence double, backend string, flipped boolean"


class BayVotes(StatefulProcessor):
    """Looks at a bay to its verdicts: strict majority of the newest mission's looks inside the window.

    Kept per bay: its looks inside the window (the earliest of those with one frame; looks without a frame all count) and the last
    verdict.  The result does not depend on the order in which looks arrive.  A row goes out whenever the verdict, its
    confidence or its backend changes; ``flipped`` marks those that change the verdict, numbered by ``change_no``.
    With ``as_of_us=None`` the clock decides what is inside the window and state expires with it.
    """

    def __init__(self, window_us: int, as_of_us: int | None = None):
        self.window_us, self.as_of_us = window_us, as_of_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.as_of_us is not None else self.window_us // 1000
        self.looks = handle.getListState("looks", "at bigint, event bigint, frame string, mission string, occupied boolean, backend string", ttl)
        self.last = handle.getValueState("last", "seq bigint, changes bigint, occupied boolean, confidence double, backend string")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        now = self.as_of_us if self.as_of_us is not None else timers.getCurrentProcessingTimeInMs() * 1000
        held = [tuple(x) for x in self.looks.get()] if self.looks.exists() else []
        live = [x for x in held if x[0] > now - self.window_us]
        place = {x[2]: i for i, x in enumerate(live) if x[2] is not None}
        fresh, rewrite = [], len(live) < len(held)
        for r in rows:
            look = (r["at"], r["event"], r["frame"], r["mission"], r["occupied"], r["backend"])
            if look[0] is None or look[0] <= now - self.window_us:
                continue
            i = place.get(look[2]) if look[2] is not None else None
            if i is None:
                if look[2] is not None:
                    place[look[2]] = len(live)
                live.append(look)
                fresh.append(look)
            elif look[:2] < live[i][:2]:
                live[i], rewrite = look, True
        if rewrite and live:
            self.looks.put(live)
        elif fresh:
            self.looks.appendList(fresh)
        elif rewrite:
            self.looks.clear()
        if not live:
            return
        mission = max(live, key=lambda x: x[:2])[3]
        votes = [x for x in live if x[3] == mission]
        n, occ = len(votes), sum(bool(x[4]) for x in votes)
        verdict = (occ * 2 > n, max(occ, n - occ) / n, max((x[5] for x in votes if x[5] is not None), default=None))
        was = tuple(self.last.get()) if self.last.exists() else None
        if was is not None and was[2:] == verdict:
            return
        flipped = was is None or was[2] != verdict[0]
        seq, changes = (was[0] if was else 0) + 1, (was[1] if was else 0) + flipped
        self.last.update((seq, changes, *verdict))
        yield Row(bay_id=key[0], seq=seq, change_no=changes, occupied=verdict[0], confidence=verdict[1], backend=verdict[2], flipped=flipped)

    def close(self) -> None:
        pass


FIRST = "drone_id string, frame_idx int, frame_id string, at bigint"


class FirstFrame(StatefulProcessor):
    """The earliest frame of the first delivery of an ingest key; every later one adds nothing.  The mark expires after ``keep_ms``."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        if not self.seen.exists():
            first = min(rows, key=lambda r: (r["at"], r["frame_id"]))
            self.seen.update((first["at"],))
            yield Row(drone_id=first["drone_id"], frame_idx=first["frame_idx"], frame_id=first["frame_id"], at=first["at"])

    def close(self) -> None:
        pass


NUMBERED = "frame_id string, drone_id string, frame_idx int, flight_no bigint, status string"


class FlightNumbers(StatefulProcessor):
    """Numbers a drone's flights: a frame index below the one before means that it started over.  Each frame also queues a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame_idx int, flight_no bigint")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        before, flight = tuple(self.last.get()) if self.last.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: (r["at"], r["frame_id"])):
            flight += before is not None and r["frame_idx"] < before
            before = r["frame_idx"]
            yield Row(frame_id=r["frame_id"], drone_id=key[0], frame_idx=r["frame_idx"], flight_no=flight, status="queued")
        self.last.update((before, flight))

    def close(self) -> None:
        pass


TONES = "who string, tone string, at_ms bigint"


class Silence(StatefulProcessor):
    """A row per change of tone of a sender: ``good`` with its first sign of life or the first after a silence, ``warn`` as soon as
    ``limit_ms`` have passed without one.

    Signs wait until the watermark has passed them, so that late ones still count; a timer makes silence itself a row.
    Of the signs in a stretch as long as the limit only the first and the last wait: those between end no silence and begin none.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at bigint")
        self.last = handle.getValueState("last", "at bigint, silent boolean")

    def held(self) -> Iterator[int]:
        return (x[0] for x in (self.pending.get() if self.pending.exists() else ()))

    def ends(self, signs: Iterable[int]) -> set[int]:
        """The first and last sign of every stretch, taken one by one."""
        stretches: dict[int, tuple[int, int]] = {}
        for at in signs:
            lo, hi = stretches.get(at // self.limit_ms, (at, at))
            stretches[at // self.limit_ms] = (min(lo, at), max(hi, at))
        return {at for both in stretches.values() for at in both}

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        yield from self.advance(key, self.ends(chain((r["at_ms"] for r in rows), self.held())), timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, set(self.held()), timerValues)

    def advance(self, key, waiting: set[int], timers) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs()
        last, silent = tuple(self.last.get()) if self.last.exists() else (None, False)
        for at in sorted(x for x in waiting if x <= now):
            if last is not None and at <= last:
                continue
            if last is not None and not silent and at - last >= self.limit_ms:
                yield Row(who=key[0], tone="warn", at_ms=last + self.limit_ms)
                silent = True
            if last is None or silent:
                yield Row(who=key[0], tone="good", at_ms=at)
            last, silent = at, False
        if last is not None and not silent and last + self.limit_ms <= now:
            yield Row(who=key[0], tone="warn", at_ms=last + self.limit_ms)
            silent = True
        if last is not None:
            self.last.update((last, silent))
        left = sorted(x for x in waiting if x > now)
        if left:
            self.pending.put([(x,) for x in left])
        elif self.pending.exists():
            self.pending.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        wake = left[:1] + ([last + self.limit_ms] if last is not None and not silent else [])
        if wake:
            self.handle.registerTimer(min(wake))

    def close(self) -> None:
        pass
