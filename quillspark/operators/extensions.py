"""Extension points: named implementations, chains that take the first that fits, and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Registry:
    """Implementations of one kind (fetcher, extractor, adapter, analyser, scorer, composer) by name, in order."""

    known: dict[str, tuple[Callable[..., bool], Callable]] = field(default_factory=dict)

    def add(self, name: str, supports: Callable[..., bool], run: Callable) -> None:
        self.known[name] = (supports, run)

    def first(self, *given) -> Callable | None:
        """The first implementation that supports what is given."""
        return next((run for supports, run in self.known.values() if supports(*given)), None)

    def all(self, *given) -> list[tuple[str, object]]:
        """Results of all implementations that support it; one that fails leaves the others' results."""
        out = []
        for name, (supports, run) in self.known.items():
            try:
                if supports(*given):
                    out.append((name, run(*given)))
            except Exception:
                continue
        return out


def with_fallback(run: Callable, other: Callable, enabled: Callable[[], bool] = lambda: True, on_failure: bool = True) -> Callable:
    """``run`` where it is enabled, ``other`` where it isn't or, if so asked, fails."""

    def chosen(*given):
        if not enabled():
            return other(*given)
        try:
            return run(*given)
        except Exception:
            if not on_failure:
                raise
            return other(*given)

    return chosen


def ask(rows: DataFrame, client: Callable[[str], str | None], prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Adds a model's reply to each row; a failed call gives null. The client is made of plain Python and runs on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> str | None:
            try:
                return client(text)
            except Exception:
                return None

        for batch in batches:
            yield batch.assign(**{reply: [one(p) for p in batch[prompt]]})

    return rows.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"`{reply}` string"]))
