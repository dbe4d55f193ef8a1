"""Frames that are kept for a while: one loader at a time, dropped by age or by the version that they were read from."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

LIFETIME = 3600.0  #: seconds


@dataclass
class _Held:
    frame: DataFrame
    version: Hashable
    since: float


class FrameCache:
    """Persisted frames by name. get() loads what is missing, too old, of another version, or empty.

    Callers of one name wait for the one that loads, and take what it loaded; other names do not wait. A frame that is
    replaced is unpersisted, and recomputed for those who still read it. Blocks live on the executors' disks and memory,
    and a lost one is read again from its source.
    """

    def __init__(self, lifetime: float = LIFETIME, clock: Callable[[], float] = time.monotonic, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.lifetime, self.clock, self.level = lifetime, clock, level
        self.held: dict[str, _Held] = {}
        self.locks: dict[str, threading.Lock] = {}
        self.guard = threading.Lock()

    def fresh(self, name: str, version: Hashable) -> DataFrame | None:
        own = self.held.get(name)
        return own.frame if own and own.version == version and self.clock() - own.since < self.lifetime else None

    def get(self, name: str, load: Callable[[], DataFrame], version: Hashable = None) -> DataFrame:
        if (frame := self.fresh(name, version)) is not None:
            return frame
        with self.guard:
            lock = self.locks.setdefault(name, threading.Lock())
        with lock:
            if (frame := self.fresh(name, version)) is not None:  # loaded while this caller waited
                return frame
            self.drop(name)
            frame = load().persist(self.level)
            if frame.isEmpty():  # an empty table may be one that is not filled yet: it is read again next time
                frame.unpersist()
                return frame
            self.held[name] = _Held(frame, version, self.clock())
            return frame

    def drop(self, name: str) -> None:
        if own := self.held.pop(name, None):
            own.frame.unpersist()


def chunks_of(cache: FrameCache, own) -> DataFrame:
    """The chunks of a SnapshotStore at its last version."""
    version = own.version()
    return cache.get(f"{own.folder}/chunks", lambda: own.read("chunks", version), version)
