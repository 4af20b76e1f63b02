"""Stateful processors: one small state per key, rows in event-time order per micro-batch.

Streams are grouped by a shard, a hash of the key (column KEY, see ``flows.sharded``): one call takes all
rows of a shard's keys, and their states are read and written together. A call for every key cost some ten
messages between Spark and Python and as many small frames, whatever the number of its rows.

A key may bring a whole micro-batch. Up to HELD_ROWS rows of a shard are ordered in memory; more go
through sorted runs in the state store, merged a part of each at a time, so a task holds a bounded number of
rows. Rows older than the state of their key are labelled ``late`` and never move the state.

Throttle, ChangeFilter, Suppression and AlarmLife see every row, however old: their
watermark is on the time of arrival (the last column), so it drops nothing. Their
state goes once a key has been silent for its windows and a further ``KEEP_MS``.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_LONG = T.StructType([T.StructField("us", T.LongType())])
KEEP_MS = 24 * 3600 * 1000
_BLOB = T.StructType([T.StructField("rows", T.BinaryType())])
ARRIVAL = "_arrival"
SHARD, KEY = "state_shard", "state_key"
HELD_ROWS = 50_000  # rows of a shard that are ordered in memory at a time
PART_ROWS = 1_000  # rows of a run that come back from the state store at a time
FAN_IN = 32  # runs that are merged at a time


class _Kept:
    """The states of a shard's keys: tuples by key that begin with a time in milliseconds, or None.

    They are one value of the state store. Its one timer is set for the earliest of the times.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.states = handle.getValueState("kept", _BLOB)
        self.timer = handle.getValueState("timer", _LONG)

    def load(self) -> dict[str, tuple]:
        return _unpacked(self.states.get()) or {}

    def save(self, states: dict[str, tuple]) -> None:
        if states:
            self.states.update(_packed(states))
        else:
            self.states.clear()
        at = min((s[0] for s in states.values() if s[0] is not None), default=None)
        stored = self.timer.get()
        if at is None or stored is not None and stored[0] <= at:
            return
        if stored is not None:
            self.handle.deleteTimer(stored[0])
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def expired(self) -> dict[str, tuple]:
        """The states when the timer has come; ``save`` sets the next one."""
        self.timer.clear()
        return self.load()

    def silent(self, timerValues) -> list[str]:
        """Drop the keys whose time has passed; which they were."""
        states, now = self.expired(), timerValues.getCurrentWatermarkInMs()
        gone = [name for name, state in states.items() if state[0] <= now]
        for name in gone:
            del states[name]
        self.save(states)
        return gone


def _packed(value) -> tuple[bytes]:
    return (zlib.compress(pickle.dumps(value, pickle.HIGHEST_PROTOCOL), 1),)


def _unpacked(stored: tuple | None):
    return pickle.loads(zlib.decompress(stored[0])) if stored else None


def _until(state: tuple | None, arrival_ms: int, width_us: int = 0) -> int:
    """When a key may go that has just been seen: after a silence of its windows and KEEP_MS."""
    until = arrival_ms + width_us // 1000 + KEEP_MS
    return max(until, state[0]) if state else until


def _value(name: str) -> str | None:
    """The value of a key of one column, as text; see ``flows.sharded``."""
    return name.partition(":")[2] if ":" in name else None


def _stretches(names: np.ndarray) -> list[tuple[str, int, int]]:
    """(name, first row, row after the last) of each stretch of equal names."""
    if not len(names):
        return []
    edge = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
    return [(names[a], a, b) for a, b in zip(edge[:-1], edge[1:])]


class _Order:
    """Puts a shard's rows of a micro-batch in order, by key first, through the state store where they are many."""

    def __init__(self, handle: StatefulProcessorHandle, by: list[str], ranks: dict[str, dict] | None = None):
        self.by, self.ranks = [KEY, *by], ranks or {}
        place = T.StructType([T.StructField("run", T.LongType()), T.StructField("part", T.LongType())])
        self.parts = handle.getMapState("runs", place, T.StructType([T.StructField("rows", T.BinaryType())]))
        self.arrival = 0

    def _sorted(self, frame: pd.DataFrame) -> pd.DataFrame:
        def rank(column: pd.Series) -> pd.Series:
            known = self.ranks.get(column.name)
            return column if known is None else column.map(known).fillna(len(known))

        return frame.sort_values(self.by, kind="stable", ignore_index=True, key=rank)

    def chunks(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows in order, a frame at a time; ``arrival`` is when the last arrived, in milliseconds."""
        held, count, runs = [], 0, []
        for frame in rows:
            if not len(frame):
                continue
            # the time of arrival is a constant of the micro-batch, and Spark may drop a constant's name
            arrived = frame[frame.columns[-1]]
            self.arrival = max(self.arrival, int(_us(arrived).max()) // 1000)
            held.append(frame.drop(columns=frame.columns[-1]))
            count += len(frame)
            if count >= HELD_ROWS:
                runs.append(self._spilled(len(runs), [self._sorted(pd.concat(held, ignore_index=True))]))
                held, count = [], 0
        if not runs:
            if held:
                yield self._sorted(pd.concat(held, ignore_index=True))
            return
        if held:
            runs.append(self._spilled(len(runs), [self._sorted(pd.concat(held, ignore_index=True))]))
        number = len(runs)
        while len(runs) > FAN_IN:  # neighbours are merged, so equal rows stay in the order of arrival
            merged = []
            for k in range(0, len(runs), FAN_IN):
                merged.append(self._spilled(number, self._merged(runs[k:k + FAN_IN])))
                number += 1
            runs = merged
        yield from self._merged(runs)

    def _spilled(self, run: int, frames) -> tuple[int, int]:
        """Write a sorted run in parts; its number and how many parts it has."""
        part = 0
        for frame in frames:
            for start in range(0, len(frame), PART_ROWS):
                self.parts.updateValue((run, part), (pickle.dumps(frame.iloc[start:start + PART_ROWS]),))
                part += 1
        return run, part

    def _merged(self, runs: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """Runs merged part by part: rows up to the first end of a loaded part cannot be preceded any more."""
        loaded, at = [None] * len(runs), [0] * len(runs)
        while True:
            for n, (run, count) in enumerate(runs):
                if loaded[n] is None and at[n] < count:
                    loaded[n] = pickle.loads(self.parts.getValue((run, at[n]))[0])
                    self.parts.removeKey((run, at[n]))
                    at[n] += 1
            live = [n for n, frame in enumerate(loaded) if frame is not None]
            if not live:
                return
            together = pd.concat(
                [loaded[n].assign(_run=n, _last=np.arange(len(loaded[n])) == len(loaded[n]) - 1) for n in live],
                ignore_index=True)
            together = self._sorted(together)
            ends = np.flatnonzero(together["_last"].to_numpy() & together["_run"].map(
                {n: at[n] < runs[n][1] for n in live}).to_numpy())
            stop = int(ends[0]) + 1 if len(ends) else len(together)
            rest = together.iloc[stop:]
            for n in live:
                mine = rest[rest["_run"] == n]
                loaded[n] = mine.drop(columns=["_run", "_last"]) if len(mine) else None
            yield together.iloc[:stop].drop(columns=["_run", "_last"]).reset_index(drop=True)


def _us(times: pd.Series) -> np.ndarray:
    if getattr(times.dt, "tz", None) is not None:
        times = times.dt.tz_convert("UTC").dt.tz_localize(None)
    return times.astype("datetime64[us]").to_numpy().astype("int64")


def _stamp(us) -> pd.Series:
    return pd.Series(np.asarray(us, "datetime64[us]")).dt.tz_localize("UTC")


class Throttle(StatefulProcessor):
    """First-anchored windows in turn (rate limit, then de-duplication) for the keys of a shard.

    ``windows`` are column names or seconds. Emits accepted and late rows with
    a ``status`` column. The state of a key is one record.
    """

    def __init__(self, windows: list[str | float], tie: str = "id"):
        self.windows, self.tie = windows, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)
        self.order = _Order(handle, ["ts", self.tie])

    def _width(self, frame: pd.DataFrame, window) -> list[int]:
        if not isinstance(window, str):
            return [int(window * 1e6)] * len(frame)
        return (frame[window].fillna(0).astype(float) * 1e6).astype("int64").tolist()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.load()
        current = first = None
        for frame in self.order.chunks(rows):
            times = _us(frame["ts"]).tolist()
            widths = [self._width(frame, window) for window in self.windows]
            picked, status = [], []
            for name, low, high in _stretches(frame[KEY].to_numpy()):
                stored = kept.get(name)
                _, *lasts, until = stored or [None] * (len(self.windows) + 2)
                if name != current:  # rows are late by the state before the micro-batch
                    current, first = name, lasts[0]
                late = [n for n in range(low, high) if first is not None and times[n] < first]
                alive = [n for n in range(low, high) if first is None or times[n] >= first]
                if alive:
                    for stage, width in enumerate(widths):
                        last, passed = lasts[stage], []
                        for at in alive:
                            if last is None or width[at] <= 0 or times[at] - last >= width[at]:
                                last = times[at]
                                passed.append(at)
                        if last is not None:
                            until = max(until or 0, last + max(width[low:high]))
                        lasts[stage], alive = last, passed
                picked += late + alive
                status += ["late"] * len(late) + ["accepted"] * len(alive)
                if lasts[0] is not None:
                    kept[name] = (_until(stored, self.order.arrival, until - lasts[0]), *lasts, until)
            if picked:
                out = frame.drop(columns=[SHARD, KEY]).iloc[picked].copy()
                out["status"] = status
                yield out
        self.kept.save(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.silent(timerValues)
        return iter(())

    def close(self) -> None:
        pass


class ChangeFilter(StatefulProcessor):
    """Trivial-change filter for one device; the state is the last value per sensor type.

    Input: flat readings of valid messages. Emits the readings of messages with
    a non-trivial change, and of late messages, with a ``status`` column.
    """

    def __init__(self, deltas: dict[str, float], levels: dict[str, float]):
        self.deltas, self.levels = deltas, levels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)
        self.order = _Order(handle, ["ts", "message_id", "pos"])

    def _trivial(self, name: str, value: float, before: float | None) -> bool:
        if before is None:
            return False
        if name in self.deltas:
            return abs(value - before) < self.deltas[name]
        return value < self.levels[name] and before < self.levels[name]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.load()
        current, before, known = None, {}, {}  # of a device per sensor type: the stored value, and the one that holds now

        def put() -> None:
            if current is not None:
                kept[current] = (_until(kept.get(current), self.order.arrival), {**before, **known})

        for frame in self._messages(self.order.chunks(rows)):
            status = []
            for name, low, high in _stretches(frame[KEY].to_numpy()):
                if name != current:
                    put()
                    current, before, known = name, *[kept[name][1] if name in kept else {}] * 2
                    known = dict(known)
                part = frame.iloc[low:high]
                status += self._judged(part, before, known)
            out = frame.drop(columns=[SHARD, KEY]).assign(status=status)
            out = out[out["status"].notna()]
            if len(out):
                yield out
        put()
        self.kept.save(kept)

    def _judged(self, frame: pd.DataFrame, before: dict, known: dict) -> list[str | None]:
        """Status of the rows of a device; ``known`` moves on."""
        times = _us(frame["ts"]).tolist()
        names, values = frame["sensor_type"].tolist(), frame["value"].tolist()
        messages = frame["message_id"].tolist()
        # One late reading makes its whole message late.
        late = {
            message for message, name, now in zip(messages, names, times)
            if name in before and now < before[name][0]
        }
        changed: set = set()
        for message, name, value, now in zip(messages, names, values, times):
            if message not in late:
                if not self._trivial(name, value, known[name][1] if name in known else None):
                    changed.add(message)
                known[name] = (now, value)
        return ["late" if m in late else "accepted" if m in changed else None for m in messages]

    @staticmethod
    def _messages(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks that end with a message; the rows of one have one time and follow each other."""
        kept = None
        for frame in chunks:
            if kept is not None:
                frame = pd.concat([kept, frame], ignore_index=True)
            same = (frame["message_id"] == frame["message_id"].iloc[-1]) & (frame["ts"] == frame["ts"].iloc[-1])
            same &= frame[KEY] == frame[KEY].iloc[-1]
            kept = frame[same.to_numpy()].reset_index(drop=True)
            if len(kept) < len(frame):
                yield frame[~same.to_numpy()].reset_index(drop=True)
        if kept is not None and len(kept):
            yield kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.silent(timerValues)
        return iter(())

    def close(self) -> None:
        pass


class Liveness(StatefulProcessor):
    """Connect and disconnect events of a shard's devices from their heartbeats."""

    def __init__(self, gap_seconds: float):
        self.gap_us = int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)

    def _spaced(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """(KEY, us) in order, without the times that lie between others of one gap-wide slot."""
        times = pd.DataFrame({KEY: pd.Series(dtype=object), "us": pd.Series(dtype="int64")})
        for chunk in rows:
            times = pd.concat([times, pd.DataFrame({KEY: chunk[KEY], "us": _us(chunk["ts"])})], ignore_index=True)
            times = times.sort_values([KEY, "us"], kind="stable", ignore_index=True)
            names, slot = times[KEY].to_numpy(), times["us"].to_numpy() // self.gap_us
            same = (slot[1:] == slot[:-1]) & (names[1:] == names[:-1])
            times = times[~(np.r_[False, same] & np.r_[same, False])]
        return times

    def _end_ms(self, last: int) -> int:
        return -(-(last + self.gap_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, events = self.kept.load(), []
        spaced = self._spaced(rows)
        every = spaced["us"].to_numpy()
        for name, low, high in _stretches(spaced[KEY].to_numpy()):
            times = every[low:high]
            end, last = kept.get(name) or (None, None)
            if last is not None:
                times = times[times >= last]
            if not len(times):
                continue
            chain = times if last is None else np.concatenate(([last], times))
            if last is None:
                events.append((_value(name), "connected", int(chain[0])))
                end = self._end_ms(int(times[-1]))
            for at in np.flatnonzero(np.diff(chain) >= self.gap_us).tolist():
                events.append((_value(name), "disconnected", int(chain[at]) + self.gap_us))
                events.append((_value(name), "connected", int(chain[at + 1])))
            kept[name] = (end, int(times[-1]))
        self.kept.save(kept)
        if events:
            yield _device_events(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, now, events = self.kept.expired(), timerValues.getCurrentWatermarkInMs(), []
        for name in [n for n, state in kept.items() if state[0] <= now]:
            last = kept[name][1]
            if self._end_ms(last) > now:
                kept[name] = (self._end_ms(last), last)
            else:
                del kept[name]
                events.append((_value(name), "disconnected", last + self.gap_us))
        self.kept.save(kept)
        if events:
            yield _device_events(events)

    def close(self) -> None:
        pass


def _device_events(events: list[tuple]) -> pd.DataFrame:
    device, what, when = zip(*events)
    return pd.DataFrame({"device_id": pd.Series(device, dtype=object), "event": what, "at": _stamp(when)})


class Presence(StatefulProcessor):
    """Connect and disconnect events of a shard's devices from their heartbeats and their other traffic.

    A device is connected while its last heartbeat is less than ``ttl_seconds`` and its last message of
    any kind less than ``idle_seconds`` ago. The two inputs have no common order, so nothing is decided before
    the watermark has passed it: what arrives in between is kept as the first and last times
    of each slot of time, which is all that can change an event. The time of a device's state is the end of its
    oldest slot, or of the connection where no slot is waiting.
    """

    SLOT = {"first_beat": "min", "last_beat": "max", "first": "min", "last": "max"}
    NEVER, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # first and last_beat without a heartbeat

    def __init__(self, ttl_seconds: float, idle_seconds: float):
        self.ttl, self.idle = int(ttl_seconds * 1e6), int(idle_seconds * 1e6)
        self.slot_us = min(self.ttl, self.idle)  # two messages of one slot never leave a gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)
        self.slots = handle.getValueState("slots", _BLOB)

    def _merged(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """One row per device and slot, in order."""
        return pd.concat(parts, ignore_index=True).groupby([KEY, "slot"], as_index=False).agg(self.SLOT)

    def _put(self, slots: pd.DataFrame) -> None:
        if len(slots):
            self.slots.update(_packed({c: slots[c].to_numpy() for c in slots.columns}))
        else:
            self.slots.clear()

    @staticmethod
    def _end(slot: int, width_us: int) -> int:
        return -(-(slot + 1) * width_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, count = [], 0
        for frame in rows:
            times, beats = _us(frame["ts"]), frame["beat"].to_numpy(bool)
            parts.append(pd.DataFrame({
                KEY: frame[KEY], "slot": times // self.slot_us,
                "first_beat": np.where(beats, times, self.NEVER), "last_beat": np.where(beats, times, self.LEAST),
                "first": times, "last": times}))
            count += len(frame)
            if count >= HELD_ROWS:
                parts, count = [self._merged(parts)], 0
        if not parts:
            return
        fresh = self._merged(parts)
        kept = self.kept.load()
        first = fresh.drop_duplicates(KEY)
        for name, slot in zip(first[KEY].tolist(), first["slot"].tolist()):
            at = self._end(slot, self.slot_us)
            timer, *state = kept.get(name) or (None, None, None, None)
            kept[name] = (at if timer is None else min(timer, at), *state)
        held = _unpacked(self.slots.get())
        self._put(fresh if held is None else self._merged([pd.DataFrame(held), fresh]))
        self.kept.save(kept)
        yield from ()

    def _step(self, state: tuple, now: int, is_beat: bool, events: list) -> tuple:
        """The state after a message; ``open`` is when the connection ends if nothing more comes."""
        beat, _, end = state
        if end is not None and end <= now:
            events.append(("disconnected", end))
            end = None
        beat = now if is_beat else beat
        alive = beat is not None and beat + self.ttl > now
        if alive and end is None:
            events.append(("connected", now))
        return beat, now, min(beat + self.ttl, now + self.idle) if alive else end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, now = self.kept.expired(), timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked(self.slots.get())
        slots = self._merged([pd.DataFrame(held)]) if held else None
        ready, waiting = {}, {}  # by device: its slots the watermark has passed, and the first one after these
        due = {name for name, state in kept.items() if state[0] is not None and state[0] * 1000 <= now}
        if slots is not None:
            passed = (slots["slot"].to_numpy() + 1) * self.slot_us <= now
            taken = slots[KEY].isin(due).to_numpy() & passed
            mine, slots = slots[taken], slots[~taken]
            rows = list(zip(*(mine[c].tolist() for c in self.SLOT)))
            ready = {name: rows[a:b] for name, a, b in _stretches(mine[KEY].to_numpy())}
            first = slots.drop_duplicates(KEY)
            waiting = dict(zip(first[KEY].tolist(), first["slot"].tolist()))
            self._put(slots)
        events: list = []
        for name in due:
            state, own = kept[name][1:], []
            for first_beat, last_beat, first, last in ready.get(name, ()):
                times = {(t, False) for t in (first, last)}
                if first_beat != self.NEVER:
                    times |= {(first_beat, True), (last_beat, True)}
                for at, is_beat in sorted(times, key=lambda r: (r[0], not r[1])):
                    if state[1] is None or at >= state[1]:
                        state = self._step(state, at, is_beat, own)
            rest = waiting.get(name)
            beat, seen, end = state
            if end is not None and end <= now and (rest is None or end <= rest * self.slot_us):
                own.append(("disconnected", end))
                end = None
            if end is None and beat is not None and beat + self.ttl <= now and rest is None:
                del kept[name]  # the heartbeat has run out: the next message starts afresh
            else:
                at = [] if rest is None else [(rest + 1) * self.slot_us]
                if end is not None:
                    at.append(end)
                elif beat is not None and rest is None:
                    at.append(beat + self.ttl)
                timer = -(-max(min(at), now + 1000) // 1000) if at else None
                kept[name] = (timer, beat, seen, end)
            events += [(_value(name), what, when) for what, when in own]
        self.kept.save(kept)
        if events:
            yield _device_events(events)

    def close(self) -> None:
        pass


class Suppression(StatefulProcessor):
    """Suppression states of a shard's devices; an activation lasts ``seconds`` and is never extended."""

    def __init__(self, seconds: float):
        self.us = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)
        self.order = _Order(handle, ["ts", "request_id"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.load()
        current = before = None
        for frame in self.order.chunks(rows):
            times, types = _us(frame["ts"]).tolist(), frame["suppression_type"].tolist()
            outcomes, anchors = [], []
            for name, low, high in _stretches(frame[KEY].to_numpy()):
                stored = kept.get(name)
                _, started, agent = stored or (None, None, None)
                if name != current:  # rows are late by the state before the micro-batch
                    current, before = name, started
                for now, wanted in zip(times[low:high], types[low:high]):
                    if before is not None and now < before:
                        outcomes.append("late")
                        anchors.append(before)
                        continue
                    if started is None or now - started >= self.us:
                        started, agent = now, wanted
                        outcomes.append("activated")
                    else:
                        outcomes.append("updated" if wanted == agent else "rejected")
                    anchors.append(started)
                kept[name] = (_until(stored, self.order.arrival, self.us), started, agent)
            yield frame.drop(columns=[SHARD, KEY]).assign(activated_at=_stamp(anchors), outcome=outcomes)
        self.kept.save(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.silent(timerValues)
        return iter(())

    def close(self) -> None:
        pass


class AlarmLife(StatefulProcessor):
    """Alarms of a shard from RAISE over ACK to RESOLVE; emits every change that takes effect.

    The two inputs have no common order: an action that arrives before its alarm waits
    for it. Actions on a resolved alarm have no effect; nor have those that stay without
    an alarm until their state goes. Of equal times RAISE comes first, RESOLVE last.
    """

    RANK = {"RAISE": 0, "ACK": 1, "RESOLVE": 2}
    COLUMNS = [KEY, "device_id", "severity", "action", "actor", "us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = _Kept(handle)  # device, severity (None while there is no alarm) and whether it is resolved
        kinds = [T.StringType()] * 5 + [T.LongType()]
        self.waiting = handle.getListState(
            "waiting", T.StructType([T.StructField(n, k) for n, k in zip(self.COLUMNS, kinds)]))
        self.order = _Order(handle, ["us", "action", "actor"], {"action": self.RANK})

    def _frames(self, rows: Iterator[pd.DataFrame], kept: dict, raised: set) -> Iterator[pd.DataFrame]:
        """The rows, then those that waited for an alarm that has come, in the columns of the order and the
        time of arrival. ``raised`` takes the keys of the alarms that come."""
        arrived = None
        for frame in rows:
            arrived = frame[frame.columns[-1]].max()
            raised.update(frame[KEY][(frame["action"] == "RAISE").to_numpy()])
            own = frame.assign(us=_us(frame["ts"]), actor=frame["actor"].fillna("").astype(object))
            yield own[self.COLUMNS].assign(_at=frame[frame.columns[-1]])
        if not any(name in kept and kept[name][2] is None for name in raised):
            return
        part, still = [], []
        for row in self.waiting.get():
            (part if row[0] in raised else still).append(tuple(row))
            if len(part) == PART_ROWS:
                yield self._waited(part, arrived)
                part = []
        if part:
            yield self._waited(part, arrived)
        self._wait(still, afresh=True)

    def _waited(self, part: list[tuple], arrived) -> pd.DataFrame:
        frame = pd.DataFrame(part, columns=self.COLUMNS)
        return frame.assign(actor=frame["actor"].fillna("")).assign(_at=arrived)

    def _wait(self, rows: list[tuple], afresh: bool = False) -> None:
        if afresh:
            self.waiting.clear()
        for start in range(0, len(rows), PART_ROWS):
            self.waiting.appendList(rows[start:start + PART_ROWS])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, raised = self.kept.load(), set()
        for frame in self.order.chunks(self._frames(rows, kept, raised)):
            early: list[tuple] = []
            changes: list[tuple] = []
            lists = [frame[c].tolist() for c in self.COLUMNS]
            for name, low, high in _stretches(frame[KEY].to_numpy()):
                stored = kept.get(name)
                _, device, severity, resolved = stored or (None, None, None, False)
                alarm = _value(name)
                for _, own, level, action, actor, us in zip(*(c[low:high] for c in lists)):
                    if severity is None and action != "RAISE":
                        if name not in raised:  # else it came before its alarm and has no effect
                            early.append((name, None, None, action, actor or None, us))
                        continue
                    if resolved or (action == "RAISE") != (severity is None):
                        continue
                    if action == "RAISE":
                        device, severity = (own if isinstance(own, str) else None), level or ""
                    elif action == "RESOLVE":
                        resolved = True
                    elif action != "ACK":
                        continue
                    changes.append((alarm, device, severity, action, actor or None, us))
                kept[name] = (_until(stored, self.order.arrival), device, severity, resolved)
            if changes:
                yield self._changes(changes)
            self._wait(early)
        self.kept.save(kept)

    @staticmethod
    def _changes(changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(changes, columns=["alarm_id", "device_id", "severity", "action", "actor", "ts"])
        return out.assign(ts=_stamp(out["ts"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = set(self.kept.silent(timerValues))
        if gone and self.waiting.exists():
            self._wait([tuple(row) for row in self.waiting.get() if row[0] not in gone], afresh=True)
        return iter(())

    def close(self) -> None:
        pass
