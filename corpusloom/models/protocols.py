"""What a model has to be: plain Python protocols, so that any library can stand behind them, and none is needed here.

A factory is sent to the workers and called once in each, so weights are loaded once a worker and never shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple, Protocol, TypeVar

import numpy as np


class Transcript(NamedTuple):
    """What a recogniser heard."""

    text: str
    language: str | None = None
    language_probability: float | None = None
    speech_seconds: float | None = None


class Recognition(NamedTuple):
    """What a character recogniser heard and how it aligns: leading and trailing are the unaligned shares of the clip."""

    text: str
    confidence: float
    mean_probability: float | None = None
    leading: float | None = None
    trailing: float | None = None


class TimedWord(NamedTuple):
    """A word with its place in time."""

    text: str
    start: float
    end: float
    probability: float | None = None


class Finding(NamedTuple):
    """A piece of personal information: its category and what found it."""

    category: str
    detector: str


class Transcriber(Protocol):
    """records -> one transcript each, in order."""

    def __call__(self, records: Sequence[dict[str, Any]]) -> Sequence[Transcript]: ...


class Recogniser(Protocol):
    """records and their target texts -> one recognition each, in order."""

    def __call__(self, records: Sequence[dict[str, Any]], targets: Sequence[str]) -> Sequence[Recognition]: ...


class TimedTranscriber(Protocol):
    """A path -> the words of a recording."""

    def __call__(self, path: str) -> Sequence[TimedWord]: ...


class PrivacyScanner(Protocol):
    """A text -> findings."""

    def __call__(self, text: str) -> Sequence[Finding]: ...


class MelScorer(Protocol):
    """(frames x bands, mask of frames) -> a score, higher is better."""

    def __call__(self, mel: np.ndarray, mask: np.ndarray) -> float: ...


class Synthesiser(Protocol):
    """(text, seed) -> (wave, the text as it was read, frames)."""

    def __call__(self, text: str, seed: int) -> tuple[np.ndarray, str, int]: ...


class SpeakerEmbedder(Protocol):
    """records -> one vector each, in order; they are brought to unit length by the adapter."""

    def __call__(self, records: Sequence[dict[str, Any]]) -> Sequence[Sequence[float]]: ...


class PitchTracker(Protocol):
    """(wave, rate) -> (pitch of each frame in Hz, 0 where there is none)."""

    def __call__(self, wave: np.ndarray, rate: int) -> np.ndarray: ...


M = TypeVar("M")
Factory = Callable[[], M]
