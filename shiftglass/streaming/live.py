"""Live sessions: zone visits as a keyed state with timers, so that a batch costs what its new frames cost.

State of a session: a small record per worker in view (see ``Follower``), the last nine
intervals between frames and the last arrival. A timer five seconds after the last arrival
ends a session whose camera went silent, whether or not a row comes: its open visits are
closed as CAMERA_LOST and its state is dropped; frames that come later begin anew. Workers
outside every zone are forgotten after a minute, so state does not grow with a session's length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..vocabulary import TRANSIT
from .zone_visits import EPS, OUTSIDE, SCHEMA

FRAME = "session string, worker string, t double, zone string, arrived timestamp"
CAMERA_LOST_S = 5.0
INTERVALS = 9


@dataclass
class Follower:
    """What must be known of a worker between two frames.

    ``spell``: when the stretch of frames in ``place`` began; ``sure``: it has lasted long
    enough; ``home`` and ``since``: the zone settled in and from when; ``way``: when the
    way out of it began; ``first``: start of the presence, ``fresh``: nothing was known before it.
    """

    first: float
    fresh: bool
    last: float
    place: str
    spell: float
    sure: bool = False
    home: str = OUTSIDE
    since: float | None = None
    way: float | None = None
    new: bool = False
    sighted: bool = False
    declared: bool = False
    marks: list = field(default_factory=list)
    told: list | None = None


class Session:
    """Follows all workers of one session, frame by frame; events come out in order."""

    def __init__(self, config: Config, limits: dict[str, dict[float, float]] | None, state: dict | None = None):
        self.c, self.limits = config, limits or {}
        state = state or {"intervals": [], "at": None}
        self.intervals, self.at = state["intervals"], state["at"]

    # ---- what is told
    def say(self, f: Follower, out: list, kind: str, zone: str, t: float, **details) -> None:
        known = {k: round(v, 3) if isinstance(v, float) else v for k, v in details.items() if v is not None}
        text = json.dumps(known, sort_keys=True, separators=(",", ":"))
        if f.told != [kind, zone, text]:
            out.append((kind, zone, round(t, 6), text))
        f.told = [kind, zone, text]

    def marks_of(self, zone: str) -> list[tuple[float, str, float, float]]:
        found = []
        for limit, share in self.limits.get(zone, {}).items():
            found.append((float(limit), "DWELL_EXCEEDED", float(limit), share))
            if share < 1:
                found.append((share * limit, "DWELL_WARNING", float(limit), share))
        return sorted(found)

    def cross(self, f: Follower, upto: float, out: list, t: float | None = None) -> None:
        """Limits of a stay that are crossed by ``upto``; told at ``t``, and dated there, if the crossing itself was not seen."""
        for after, kind, limit, share in self.marks_of(f.home):
            at = f.since + after
            if [kind, limit] in f.marks or at > upto + EPS:
                continue
            f.marks.append([kind, limit])
            unseen = t is not None and at > f.last + EPS
            self.say(f, out, kind, f.home, t if unseen else at, limit_s=limit, warn_fraction=share if kind == "DWELL_WARNING" else None, crossed_unobserved=True if unseen else None)

    # ---- frames
    def frame(self, t: float, seen: dict[str, str], workers: dict[str, Follower]) -> list[tuple]:
        """One frame: who is in which zone (OUTSIDE for none). Rows (worker, event_type, zone_id, t, details)."""
        if self.at is not None:
            self.intervals = [*self.intervals, t - self.at][-INTERVALS:]
        self.at, told = t, []
        tolerance = max(self.c.gap_tolerance_s, 2.5 * median(self.intervals) if self.intervals else 0.0)
        for worker in sorted({*workers, *seen}):
            out: list = []
            if worker in workers and self.absent(t, worker, workers, worker in seen, out):
                told += [(worker, *x) for x in out]
                out = []
            if worker in seen:
                self.present(t, seen[worker], worker, workers, tolerance, out)
            told += [(worker, *x) for x in out]
        return told

    def absent(self, t: float, worker: str, workers: dict[str, Follower], back: bool, out: list) -> bool:
        """What the time since a worker was seen means; True if they are no longer followed."""
        f = workers[worker]
        gap = t - f.last
        if f.home != OUTSIDE and gap > min(self.c.lost_grace_s, self.c.lost_ttl_s) + EPS and not f.declared and gap > self.c.lost_grace_s + EPS:
            f.declared = True
            self.say(f, out, "LOST_IN_ZONE", f.home, f.last, last_seen_s=f.last, declared_at_s=t)
        if f.home != OUTSIDE and gap > self.c.lost_ttl_s + EPS:
            self.say(f, out, "EXITED_ZONE", f.home, f.last, reason="LOST", unverifiable=True, dwell_s=max(f.last - f.since, 0.0), last_seen_s=f.last, declared_at_s=t)
            del workers[worker]
            return True
        if f.home == OUTSIDE and gap > self.c.forget_after_s:
            del workers[worker]
            return True
        if back and f.declared:
            f.declared = False
            self.say(f, out, "REAPPEARED", f.home, t, gap_s=gap, last_seen_s=f.last)
        return False

    def present(self, t: float, place: str, worker: str, workers: dict[str, Follower], tolerance: float, out: list) -> None:
        f = workers.get(worker)
        gap = None if f is None else t - f.last
        if f is None or gap > self.c.lost_ttl_s + EPS:
            # a presence begins; who was outside a moment ago is not seen for the first time
            f = workers[worker] = Follower(first=t, fresh=f is None, last=t, place=place, spell=t)
            unwatched = starts = True
        else:
            unwatched = gap > tolerance
            starts = unwatched or place != f.place
        if starts:
            f.place, f.spell, f.sure = place, t, False
        # the way out: frames elsewhere than home, unbroken since they began
        if unwatched or place == f.home or f.new:
            f.way = None
        f.new = False
        if place == OUTSIDE:
            f.way = f.spell if f.way is None else min(f.way, f.spell)
        way = f.spell if f.way is None else f.way
        if f.home != OUTSIDE:
            self.cross(f, t if place == f.home else way, out, t if unwatched else None)
        settles = not f.sure and t - f.spell >= (self.c.exit_confirm_s if place == OUTSIDE else self.c.enter_confirm_s) - EPS
        f.sure |= settles
        if settles and place != f.home:
            if f.home != OUTSIDE:
                self.say(f, out, "EXITED_ZONE", f.home, way, reason="LEFT", dwell_s=max(way - f.since, 0.0), first_sighting=True if f.sighted else None)
            f.home, f.since, f.marks, f.new = place, f.spell, [], True
            f.sighted = f.fresh and f.spell <= f.first + EPS
            if place != OUTSIDE:
                self.say(f, out, "ENTERED_ZONE", place, f.spell, first_sighting=True if f.sighted else None)
                self.cross(f, t, out)
        f.last = t

    def close(self, workers: dict[str, Follower], reason: str) -> list[tuple]:
        """Visits that are open when the session ends."""
        told = []
        for worker in sorted(workers):
            f, out = workers[worker], []
            if f.home != OUTSIDE:
                end = max(f.last, f.since)
                self.say(f, out, "EXITED_ZONE", f.home, end, reason=reason, unverifiable=True, dwell_s=end - f.since, last_seen_s=end)
            told += [(worker, *x) for x in out]
        return told


class _Host(StatefulProcessor):
    def __init__(self, config: Config, limits: dict | None, lost_s: float):
        self.c, self.limits, self.lost_ms = config, limits, int(lost_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "intervals string, at double, due long")
        self.workers = handle.getMapState("workers", "worker string", "follower string")

    def _load(self) -> tuple[Session, dict[str, Follower], int | None]:
        kept = self.clock.get() if self.clock.exists() else None
        state = {"intervals": json.loads(kept[0]), "at": kept[1]} if kept else None
        return Session(self.c, self.limits, state), {k[0]: Follower(**json.loads(v[0])) for k, v in self.workers.iterator()}, kept[2] if kept else None

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterable[pd.DataFrame]:
        session, workers, due = self._load()
        known, pdf, out = set(workers), pd.concat(list(rows)), []
        pdf = pdf[pdf["t"].notna()]
        if session.at is not None:
            pdf = pdf[pdf["t"] > session.at + EPS]  # a frame that comes after a later one was told is left out
        for t, people in pdf.sort_values("t", kind="stable").groupby("t", sort=True):
            seen = {w: OUTSIDE if z is None or z == TRANSIT or z != z else z for w, z in zip(people["worker"], people["zone"]) if isinstance(w, str)}
            out += session.frame(float(t), seen, workers)
        for gone in known - set(workers):
            self.workers.removeKey((gone,))
        for worker, f in workers.items():
            self.workers.updateValue((worker,), (json.dumps(asdict(f)),))
        if len(pdf):
            heard = math.floor(pdf["arrived"].max().timestamp() * 1000) if pdf["arrived"].notna().any() else 0
            now = max(timerValues.getCurrentProcessingTimeInMs() if self.by_clock else heard, due - self.lost_ms if due else 0)
            if due is not None and due != now + self.lost_ms:
                self.handle.deleteTimer(due)
            due = now + self.lost_ms
            self.handle.registerTimer(due)
            self.clock.update((json.dumps(session.intervals), session.at, due))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterable[pd.DataFrame]:
        session, workers, _ = self._load()
        out = session.close(workers, "CAMERA_LOST")
        self.workers.clear()
        self.clock.clear()
        yield self._frame(key, out)

    by_clock = False

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


class _ClockHost(_Host):
    by_clock = True


def follow(frames: DataFrame, config: Config | None = None, limits: dict | None = None, lost_s: float = CAMERA_LOST_S, by_clock: bool = False) -> DataFrame:
    """Zone events of a stream of ``FRAME`` rows as they are told: session, worker, event_type, zone_id, t, details.

    A frame with nobody in it is a row without a worker. Silence is measured against the
    arrivals of all sessions (the watermark), or against the wall clock if ``by_clock``.
    Frames need not be sorted within a micro-batch; one older than what was told is left
    out. Needs the RocksDB state store.
    """
    kind = _ClockHost if by_clock else _Host
    timed = frames if by_clock else frames.withWatermark("arrived", "0 seconds")
    return timed.groupBy("session").transformWithStateInPandas(
        statefulProcessor=kind(config or Config(), limits, lost_s), outputStructType=SCHEMA, outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime"
    )


def run(frames: DataFrame, root: str, checkpoint: str, config: Config | None = None, limits: dict | None = None, **how):
    """A query that takes a stream of ``FRAME`` rows in; events are appended to ``root``/events, each once."""
    return follow(frames, config, limits, **how).writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", checkpoint).outputMode("append")
