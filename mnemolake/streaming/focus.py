"""Bounded focus per session, as a stateful processor. Workers import this module, so it needs no session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Focus(StatefulProcessor):
    """Per session the few most important turns; each new turn makes the held ones fade, and the weakest leaves."""

    def __init__(self, size: int = 5, fade: float = 0.9):
        self.size, self.fade = size, fade

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "items string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = json.loads(self.held.get()[0]) if self.held.exists() else []
        for pdf in rows:
            for turn, importance in sorted(zip(pdf["turn"].tolist(), pdf["importance"].tolist(), strict=True)):
                items = sorted([[t, a * self.fade] for t, a in items] + [[int(turn), float(importance)]], key=lambda x: (-x[1], x[0]))[: self.size]
        self.held.update((json.dumps(items),))
        yield pd.DataFrame({"session_id": [key[0]] * len(items), "turn": [t for t, _ in items], "activation": [a for _, a in items]})

    def close(self) -> None:
        pass


#: Fixed values of the buffer: fading a minute, what a strong feeling gives back a minute, and the levels that decide who leaves.
FADE, LIFT, STRONG, GONE = 0.02, 0.1, 0.5, 0.1
WEAK, DULL, LOW, SAFE = 0.3, 0.3, 0.5, 0.8


def faded(activation: float, valence: float, minutes: float) -> float:
    """Activation after some minutes: each takes a fiftieth; feelings above .5 give back a tenth of themselves, up to 1."""
    left = (1 - FADE) ** minutes
    if valence > STRONG:
        return min(1.0, activation * left + LIFT * valence * (1 - left) / FADE)
    return activation * left


def leaver(items: dict[int, tuple[float, float]]) -> int:
    """Which of the items (activation, valence) leaves a full buffer: weak and dull ones first, then those below .5, then those below .8; ties to the earlier turn."""
    for some, weight in (
        ([t for t, (a, v) in items.items() if a < WEAK and v < DULL], lambda t: items[t][0] + items[t][1]),
        ([t for t, (a, _) in items.items() if a < LOW], lambda t: items[t][0]),
        ([t for t, (a, _) in items.items() if a < SAFE], lambda t: items[t][0]),
        (list(items), lambda t: items[t][0]),
    ):
        if some:
            return min(some, key=lambda t: (weight(t), t))
    raise ValueError("no items")


def advance(held: dict[int, tuple[float, float]], last: int | None, new: list[tuple[int, int, float, float]], size: int, idle: int) -> tuple[list[tuple[int, dict[int, tuple[float, float]]]], dict[int, tuple[float, float]], int | None]:
    """What a session gave as it fell idle (with its last time), holds, and its last time, after new turns (at_ms, turn, importance, valence)."""
    gave = []
    for at, turn, importance, valence in sorted(new):
        at = at if last is None else max(at, last)
        if last is not None and at > last + idle:  # its timer has not come yet
            gave.append((last, held))
            held = {}
        elif last is not None:
            held = {t: (faded(a, v, (at - last) / 60_000), v) for t, (a, v) in held.items()}
            held = {t: (a, v) for t, (a, v) in held.items() if a >= GONE}
        held = {t: x for t, x in held.items() if t != turn}
        while len(held) >= size:
            del held[leaver(held)]
        held[int(turn)] = (float(importance), float(valence))
        last = at
    return gave, held, last


class TimedFocus(StatefulProcessor):
    """Per session the turns in focus, which fade with event time; a session idle for so long gives what it held and leaves the store.

    Items are a map state of at most `size` entries. Fading is computed when a session is touched, so one timer a session is
    enough. A turn that is earlier than the last one counts at the time of the last; a turn seen again replaces its item.
    """

    def __init__(self, size: int = 5, idle_minutes: int = 30):
        self.size, self.idle = size, idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "turn long", "activation double, valence double")
        self.last = handle.getValueState("last", "at_ms long")

    def _held(self) -> dict[int, tuple[float, float]]:
        return {int(k[0]): (float(v[0]), float(v[1])) for k, v in self.items.iterator()}

    def _rows(self, session: str, last: int, held: dict[int, tuple[float, float]]) -> pd.DataFrame:
        turns = sorted(held)
        return pd.DataFrame({"session_id": [session] * len(turns), "last_ms": [last] * len(turns), "turn": turns, "activation": [held[t][0] for t in turns]}).astype({"last_ms": "int64", "turn": "int64", "activation": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        last = int(self.last.get()[0]) if self.last.exists() else None
        new = [r for pdf in rows for r in zip(pdf["at_ms"].tolist(), pdf["turn"].tolist(), pdf["importance"].tolist(), pdf["valence"].tolist(), strict=True)]
        if last is not None:
            self.handle.deleteTimer(last + self.idle)
        gave, held, last = advance(dict(before), last, new, self.size, self.idle)
        for then, items in gave:
            yield self._rows(key[0], then, items)
        for t in before.keys() - held.keys():
            self.items.removeKey((t,))
        for t, x in held.items():
            if before.get(t) != x:
                self.items.updateValue((t,), x)
        self.last.update((last,))
        self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        yield self._rows(key[0], last, self._held())
        self.items.clear()
        self.last.clear()

    def close(self) -> None:
        pass


class PackedFocus(StatefulProcessor):
    """As TimedFocus, for transformWithState: a session is one value of at most `size` items and rows are plain.

    Each call of the store is a message to the JVM and each pandas frame costs as much as a session's whole work, so a session
    takes one read, one write and its timer, and no frames.
    """

    def __init__(self, size: int = 5, idle_minutes: int = 30):
        self.size, self.idle = size, idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "last long, turns array<long>, activations array<double>, valences array<double>")

    def _held(self) -> tuple[int | None, dict[int, tuple[float, float]]]:
        found = self.state.get()
        return (None, {}) if found is None else (int(found[0]), {t: (a, v) for t, a, v in zip(*found[1:], strict=True)})

    def _rows(self, session: str, last: int, held: dict[int, tuple[float, float]]) -> Iterator[Row]:
        for t in sorted(held):
            yield Row(session_id=session, last_ms=last, turn=t, activation=held[t][0])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, held = self._held()
        gave, held, last = advance(held, before, [(r["at_ms"], r["turn"], r["importance"], r["valence"]) for r in rows], self.size, self.idle)
        for then, items in gave:
            yield from self._rows(key[0], then, items)
        self.state.update((last, list(held), [a for a, _ in held.values()], [v for _, v in held.values()]))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, held = self._held()
        self.state.clear()
        yield from self._rows(key[0], last, held)

    def close(self) -> None:
        pass
