"""How far a pass of the index is: frames of phases, throttled, as a stream for any number of readers."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Seconds between frames of one phase while it runs.
THROTTLE = 0.5
#: Frames that are held, for those who look back and for each reader.
FRAMES = 256


class Reader:
    """Frames since it was opened, in order, up to ``size`` that are not read yet. One that falls behind further loses
    those, and gets one frame instead (state ``lagged``) with how many and the latest of every phase; then what follows.
    Nobody waits for a slow reader."""

    def __init__(self, status: Callable[[], dict[str, dict]], size: int = FRAMES):
        self._status, self._size, self._ready = status, size, threading.Condition()
        self._frames: deque[dict] = deque()
        self._missed, self._closed = 0, False

    def put(self, frame: dict) -> None:
        with self._ready:
            if self._closed:
                return
            if self._missed or len(self._frames) >= self._size:
                self._missed += len(self._frames) + 1
                self._frames.clear()
            else:
                self._frames.append(frame)
            self._ready.notify()

    def get(self, timeout: float | None = None) -> dict | None:
        """The next frame; None if none comes in time or the reader is closed and all is read."""
        with self._ready:
            self._ready.wait_for(lambda: self._frames or self._missed or self._closed, timeout)
            if not self._missed:
                return self._frames.popleft() if self._frames else None
            missed, self._missed = self._missed, 0
            # Taken before any later frame is let in, so what follows is newer.
            return {"phase": "", "state": "lagged", "counts": {"missed": missed}, "status": self._status()}

    def __iter__(self) -> Iterator[dict]:
        while (frame := self.get()) is not None:
            yield frame

    def close(self) -> None:
        with self._ready:
            self._closed = True
            self._ready.notify_all()


@dataclass
class Progress:
    """Called with a phase, its state and counts. Frames go to every listener and reader; a running phase sends one each
    THROTTLE seconds at most, changes of state always go. The last FRAMES frames and the latest of each phase can be read."""

    listeners: list[Callable[[dict], None]] = field(default_factory=list)
    clock: Callable[[], float] = time.monotonic
    frames: list[dict] = field(default_factory=list)
    status: dict[str, dict] = field(default_factory=dict)
    _sent: dict[str, float] = field(default_factory=dict)
    _readers: list[Reader] = field(default_factory=list)
    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def __call__(self, phase: str, state: str, counts: dict | None = None) -> bool:
        """Whether the frame was sent. Phases may be told of from several threads."""
        with self._lock:
            before = self.status.get(phase)
            frame = {"phase": phase, "state": state, "counts": dict(counts or {})}
            self.status = self.status | {phase: frame}
            now = self.clock()
            if before is not None and before["state"] == state == "running" and now - self._sent[phase] < THROTTLE:
                return False
            self._sent[phase] = now
            self.frames = [*self.frames, frame][-FRAMES:]
            for listener in self.listeners:
                listener(frame)
            for reader in self._readers:
                reader.put(frame)
            return True

    def reader(self, size: int = FRAMES) -> Reader:
        """A stream of what comes from now on, after one frame for every phase that there is."""
        with self._lock:
            out = Reader(lambda: self.status, max(size, len(self.status), 1))
            for frame in self.status.values():
                out.put(frame)
            self._readers = [*self._readers, out]
            return out

    def leave(self, reader: Reader) -> None:
        with self._lock:
            self._readers = [r for r in self._readers if r is not reader]
        reader.close()

    def follow(self, spark: SparkSession, name: str) -> StreamingQueryListener:
        """Tells of the batches of a streaming query of this name, as Spark reports them: a frame for each batch, ``done``
        or ``failed`` at its end. Remove the listener that it returns when it is of no use any more."""
        told = _Told(self, name)
        spark.streams.addListener(told)
        return told


class _Told(StreamingQueryListener):
    def __init__(self, progress: Progress, name: str):
        self._progress, self._name, self._runs = progress, name, set()

    def onQueryStarted(self, event):
        if event.name == self._name:
            self._runs.add(event.runId)
            self._progress(self._name, "running")

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self._name:
            self._progress(self._name, "running", {"batch": p.batchId, "milliseconds": p.batchDuration})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId in self._runs:
            self._runs.discard(event.runId)
            self._progress(self._name, "failed" if event.exception else "done", {"error": event.exception[:2000]} if event.exception else None)
