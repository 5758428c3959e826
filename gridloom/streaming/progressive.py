"""Results that come coarse first, and windows over event streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.select import chunk_rows
from ..storage import release, staged
from ..tensor import LodTensor, Tensor


@dataclass(frozen=True)
class Version:
    """A result's standing: a preview of some level, or final. Final outranks previews, finer outrank coarser ones."""

    level: int

    final = property(lambda self: self.level == 0)

    def __lt__(self, other: Version) -> bool:
        return self.level > other.level

    @staticmethod
    def combined(*parts: Version) -> Version:
        """A result is as good as its worst input."""
        return Version(max(p.level for p in parts))


def progressive(lod: LodTensor, query: Callable[[Tensor], DataFrame], seconds: float | None = None) -> Iterator[tuple[Version, DataFrame]]:
    """``query`` on each level, coarsest first, until the finest or the deadline; one answer is always given."""
    began = time.time()
    for k in reversed(range(len(lod.levels))):
        yield Version(k), query(lod.levels[k].inner)
        if seconds is not None and time.time() - began > seconds:
            return


#: How much a batch grows if it was quick, and shrinks if it was slow.
GROWTH, SHRINKING = 4, 2


def in_batches(t: Tensor, query: Callable[[DataFrame], DataFrame], seconds: float, chunks: Iterable[int] | None = None, first: int = 1, clock: Callable[[], float] = time.time) -> Iterator[tuple[list[int], list[Row]]]:
    """``query`` on the rows of batches of chunks, one after another, until all are done or the time is up: ``(chunks, rows)`` for each.

    A batch that takes less than a fourth of the time that is left is followed by one of
    four times as many chunks, one that takes more than half of it by half as
    many; one batch is always done. The source reads a batch's chunks alone. What the caller
    doesn't get in time it asks for again, by the chunks that are missing.
    """
    rest = list(range(t.shape().num_chunks) if chunks is None else chunks)
    end, size = clock() + seconds, max(1, first)
    while rest:
        batch, rest = rest[:size], rest[size:]
        began = clock()
        yield batch, query(chunk_rows(t, batch)).collect()
        took, left = clock() - began, end - clock()
        if left <= 0:
            return
        if took < left / GROWTH:
            size *= GROWTH
        elif took > left / 2:
            size = max(1, size // SHRINKING)


class FrameCache:
    """Results by key that outlive a frame: the best version of each, stored, for the next frames to show or go on from.

    Final results stay until they are forgotten. Previews are dropped once they
    are ``keep`` frames old, unless they were used again; a worse version never replaces a better one.
    """

    def __init__(self, keep: int = 2):
        self.keep, self.frame = keep, 0
        self._held: dict[object, tuple[Version, int, DataFrame]] = {}

    def next_frame(self) -> None:
        self.frame += 1
        for key, (version, used, _) in list(self._held.items()):
            if not version.final and self.frame - used >= self.keep:
                self.forget(key)

    def put(self, key, version: Version, result: DataFrame) -> bool:
        """Stores a result unless a better one is there; says whether it did."""
        held = self._held.get(key)
        if held is not None and version < held[0]:
            return False
        stored = staged(result, "frame")
        self.forget(key)
        self._held[key] = version, self.frame, stored
        return True

    def get(self, key) -> tuple[Version, DataFrame] | None:
        held = self._held.get(key)
        if held is None:
            return None
        self._held[key] = held[0], self.frame, held[2]
        return held[0], held[2]

    def forget(self, key) -> None:
        held = self._held.pop(key, None)
        if held is not None:
            release(held[2])

    def refined(self, key, lod: LodTensor, query: Callable[[Tensor], DataFrame], seconds: float | None = None) -> tuple[Version, DataFrame]:
        """The best result within the time: goes on from the level that an earlier frame reached, and starts anew where nothing is known."""
        began, held = time.time(), self.get(key)
        for k in reversed(range(len(lod.levels) if held is None else held[0].level)):
            self.put(key, Version(k), query(lod.levels[k].inner))
            if seconds is not None and time.time() - began > seconds:
                break
        return self.get(key)


def event_windows(events: DataFrame, every: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum and extremes of ``value`` over tumbling or sliding windows of ``ts``, batch or streaming.

    ``late`` sets the watermark that lets a stream close its windows.
    """
    if late:
        events = events.withWatermark("ts", late)
    over = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = events.groupBy(over.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "low", "high")


def event_sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of each key, ended by ``gap`` without events."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("session"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), key, "n", "total")
