"""Models behind the engine: the tracker and detector interfaces, their profile hooks, and a factory.

A model is no part of the library.  It works on frames of one partition (`masks.map_frames`), so an
implementation is made on the executor, by name, from settings."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import pandas as pd


class Profile:
    """Durations of stages in ms, as rows (frame, stage, value_ms) for `operators.profile`."""

    def __init__(self) -> None:
        self.frame, self.rows = 0, []

    def record(self, stage: str, value_ms: float) -> None:
        self.rows.append((self.frame, stage, float(value_ms)))

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, 1000.0 * (time.perf_counter() - began))

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=["frame", "stage", "value_ms"])


class Detector(Protocol):
    """Detections of one frame, or of several at once: tables with label, score and mask pixels."""

    def detect(self, frame: pd.DataFrame) -> pd.DataFrame: ...

    def detect_batch(self, frames: list[pd.DataFrame]) -> list[pd.DataFrame]: ...


class Tracker(ABC):
    """Starts from seeds, then gives mask logits and presence scores frame by frame."""

    profile: Profile | None = None

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Measures a stage if a profile is attached."""
        if self.profile is None:
            yield
        else:
            with self.profile.stage(name):
                yield

    @abstractmethod
    def initialize(self, frame: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame: ...

    @abstractmethod
    def track(self, frame: pd.DataFrame) -> pd.DataFrame: ...

    def correct(self, frame: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        """A correction starts anew from its seeds, unless the tracker knows better."""
        return self.initialize(frame, seeds)

    def close(self) -> None:
        """Nothing to free by default."""


_FACTORIES: dict[str, Callable[[dict], Tracker]] = {}


def register(name: str, make: Callable[[dict], Tracker]) -> None:
    _FACTORIES[name] = make


def build(settings: dict[str, Any], name: str | None = None) -> Tracker:
    """The tracker that is registered under `name`, or under settings["tracker"], made from the settings."""
    key = name or settings.get("tracker")
    if key not in _FACTORIES:
        raise ValueError(f"no tracker is registered as {key!r}; known: {sorted(_FACTORIES)}")
    return _FACTORIES[key](settings)
