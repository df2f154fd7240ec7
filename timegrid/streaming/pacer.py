"""A buffer that takes chunks as they come and releases them on a clock of its own, for streams and for batches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

BUFFERING, PLAYING = "buffering", "playing"
SCHEMA = "stream string, at double, action string, pts double"


@dataclass(frozen=True)
class Rules:
    """All in seconds but max_items. live: a full buffer evicts its oldest chunk, else the new one is refused."""

    live: bool = False
    max_items: int = 512
    prebuffer: float = 2.0
    lead: float = 1.5
    grace: float = 2.0
    dry: float = 1.0
    skip: float = 2.0

    @classmethod
    def for_live(cls) -> Rules:
        return replace(cls(), live=True, prebuffer=1.5)


@dataclass
class Pacer:
    """One stream's state. Time is an input: the same rows in the same order always give the same actions.

    A buffer waits until it spans `prebuffer`, then plays from its head's time on: (play, pts) anchors the clock. While it
    plays, chunks up to `lead` ahead of the clock are released in order; those more than `grace` behind it are dropped. A
    buffer that stays empty for `dry` pauses and waits again; a live one whose head is more than `prebuffer` + `skip` ahead
    jumps there.
    """

    rules: Rules
    items: list[float] = field(default_factory=list)
    phase: str = BUFFERING
    origin: float = 0.0
    anchor: float = 0.0
    empty_since: float | None = None

    def feed(self, at: float, pts: float | None) -> Iterator[tuple[str, float | None]]:
        """What happens when a chunk comes, or (pts None) time goes on."""
        r = self.rules
        if pts is not None and len(self.items) >= r.max_items:
            if r.live:
                yield "evict", self.items.pop(0)
            else:
                yield "refuse", pts
                pts = None
        if pts is not None:
            self.items.append(pts)
            self.items.sort()
        if self.phase == BUFFERING:
            if not self.items or self.items[-1] - self.items[0] < r.prebuffer:
                return
            yield self._play(at, "play")
        now = self.origin + at - self.anchor
        if r.live and self.items and self.items[0] - now > r.prebuffer + r.skip:
            yield self._play(at, "skip")
            now = self.origin
        while self.items and self.items[0] <= now + r.lead:
            head = self.items.pop(0)
            yield ("drop" if head + r.grace < now else "release"), head
            self.empty_since = at
        if self.items:
            self.empty_since = None
        elif self.empty_since is not None and at - self.empty_since > r.dry:
            self.phase, self.empty_since = BUFFERING, None
            yield "pause", None

    def _play(self, at: float, name: str) -> tuple[str, float]:
        self.phase, self.origin, self.anchor, self.empty_since = PLAYING, self.items[0], at, None
        return name, self.origin


def _actions(pacer: Pacer, key: str, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame = frame.sort_values(["at", "pts"], kind="stable")
        rows = [(key, at, *x) for at, pts in zip(frame["at"], frame["pts"], strict=True) for x in pacer.feed(at, None if pd.isna(pts) else pts)]
        yield pd.DataFrame(rows, columns=["stream", "at", "action", "pts"])


def pace(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(stream, at, action, pts) of arrivals (stream, at, pts); a null pts is a tick of the clock. For batches: a stream's
    arrivals are folded in order by one task."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return next(iter(_actions(Pacer(rules), key[0], [frame])))

    return rows.select("stream", "at", "pts").groupBy("stream").applyInPandas(fold, SCHEMA)


def pace_stream(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """pace() of a streaming DataFrame: each stream's Pacer is kept as state; a micro-batch's rows are taken in time order."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pacer = Pacer(rules, **json.loads(state.get[0])) if state.exists else Pacer(rules)
        batch = pd.concat(list(frames))
        yield from _actions(pacer, key[0], [batch])
        state.update((json.dumps({k: v for k, v in vars(pacer).items() if k != "rules"}),))

    grouped = rows.select("stream", "at", "pts").groupBy("stream")
    return grouped.applyInPandasWithState(fold, SCHEMA, "pacer string", "append", "NoTimeout")
