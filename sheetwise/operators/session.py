"""Models that live as long as a Python worker, not as long as a task."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle

#: Models that a worker keeps; the one that was used longest ago goes first.
KEPT = 8
#: Tiles that a model is given at once, however many rows Spark sends in a batch.
BATCH = 32
_models: OrderedDict[str, Callable] = OrderedDict()


def session_key(factory: Callable) -> str:
    """A name for a factory and what it closes over, the same for every task."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def model(key: str, factory: Callable[[], Callable]) -> Callable:
    """This worker's model of that name; built at its first use, then kept for later tasks and queries."""
    if key in _models:
        _models.move_to_end(key)
        return _models[key]
    made = factory()
    while len(_models) >= KEPT:
        _models.popitem(last=False)
    _models[key] = made
    return made


def in_batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``size``; the last one may have fewer."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        at = 0
        while n + len(frame) - at >= size:
            held.append(frame.iloc[at : at + size - n])
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            at += size - n
            held, n = [], 0
        if at < len(frame):
            held.append(frame.iloc[at:])
            n += len(frame) - at
    if held:
        yield pd.concat(held, ignore_index=True)
