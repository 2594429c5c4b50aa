"""Pluggable scorers: a function over batches of requests runs on the executors, batch by batch.

The scorer must return one response per request, in order; a batch is checked as a whole
before any of its rows is given out, and the scorer's identity must not change around a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    def identity(self) -> str: ...

    def predict(self, requests: Sequence[str]) -> Sequence[tuple[str, dict[str, float]]]: ...


def scored(requests: DataFrame, make: Callable[[], Scorer], batch: int = 64, expected: str | None = None) -> DataFrame:
    """requests (id, request) with choice, probabilities and the scorer's identity. make builds a scorer in each task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for rows in it:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                before = scorer.identity()
                answers = list(scorer.predict(part["request"].tolist()))
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} responses to {len(part)} requests")
                for choice, p in answers:
                    if choice not in p or abs(sum(p.values()) - 1) > 0.02 or p[choice] < max(p.values()) - 1e-4:
                        raise ValueError(f"not a distribution with its choice at the top: {choice} {p}")
                if scorer.identity() != before or (expected is not None and before != expected):
                    raise ValueError("the scorer changed during a batch")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "choice": [a[0] for a in answers], "probabilities": [a[1] for a in answers], "identity": before})

    return requests.select("id", "request").mapInPandas(run, f"id {dict(requests.dtypes)['id']}, choice string, probabilities map<string,double>, identity string")


def concurrent(call: Callable[[str], object], requests: Sequence[str], at_once: int = 32) -> list:
    """Answers in the order of the requests, with at most at_once calls in flight."""
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, 32))) as pool:
        return list(pool.map(call, requests))
