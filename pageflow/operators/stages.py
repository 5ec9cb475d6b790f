"""Model stages behind an interface, retries, and chat sessions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds to wait before each new attempt.
WAITS = (3, 8, 20, 45)


class Model(Protocol):
    """A model that is loaded once on each Python worker."""

    def load(self) -> Any: ...

    def run(self, loaded: Any, rows: pd.DataFrame) -> pd.DataFrame: ...


def first_loadable(*loaders: Callable[[], Any]) -> Any:
    """The first of several loaders that works (specialised, then generic); the last error if none does."""
    error: Exception | None = None
    for loader in loaders:
        try:
            return loader()
        except (OSError, ImportError, ValueError, RuntimeError) as e:
            error = e
    raise error or ValueError("no loader given")


def infer(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """Runs the model over Arrow batches of whole partitions. Write the result before using it twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = model.load()
        for frame in frames:
            yield model.run(loaded, frame)

    return rows.mapInPandas(run, schema)


def with_retries(call: Callable[[], Iterator[str]], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> str:
    """The joined chunks of a streamed answer. A failed attempt's chunks are dropped; the last failure is raised."""
    for wait in (*waits, None):
        try:
            return "".join(call())
        except Exception:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError


def chat(requests: DataFrame, answer: Callable[[list[tuple[str, str]], str], Iterator[str]], *, exchanges: int = 6, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """session, turn, response: requests (session, turn, request) answered in order, with the last exchanges as history.

    Sessions are dealt by key, and one session's turns are answered one after the other, since each needs the one before.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        history: list[tuple[str, str]] = []
        rows = []
        for r in frame.sort_values("turn").itertuples(index=False):
            said = with_retries(lambda r=r: answer(history[-exchanges:], r.request), waits)
            history.append((r.request, said))
            rows.append((r.session, r.turn, said))
        return pd.DataFrame(rows, columns=["session", "turn", "response"])

    return requests.select("session", "turn", "request").groupBy("session").applyInPandas(run, "session string, turn long, response string")
