"""Keyed stream state: which URLs were judged and which product keys are taken, in the state store.

Both processors look up one key at a time, so a batch costs what its own rows cost, however long the history is. They are
called once per bucket of keys (see `bucket`), not once per key, as a call costs far more than a lookup. Of the rows of a
key only the earliest is held.
"""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUILT, GATED, UNEXTRACTABLE = "built", "gated", "unextractable"
#: place orders the rows of a batch; payload is the product as JSON.
ROW = "url string, place string, status string, gate_reason string, dedup_key string, complete boolean, payload string"
ROW_NAMES = [part.split()[0] for part in ROW.split(", ")]


#: Buckets of keys; fixed for the life of a checkpoint. Rows sent to the JVM at a time.
BUCKETS, SENT = 2048, 2_000


def bucket(key) -> Column:
    """The group in which the rows of a key meet."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _frames(rows, names: list[str]):
    """Frames of SENT rows at most."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == SENT:
            yield pd.DataFrame(out, columns=names, dtype="object")
            out = []
    if out:
        yield pd.DataFrame(out, columns=names, dtype="object")


class _Known:
    """Keys of one bucket in the state store; a bucket without any is not asked for each key."""

    def __init__(self, state) -> None:
        self.state, self.some = state, state.exists()

    def __contains__(self, key: str) -> bool:
        return self.some and self.state.containsKey((key,))

    def add(self, key: str) -> None:
        self.state.updateValue((key,), (True,))


class FirstVisit(StatefulProcessor):
    """Of the rows of one visit (URL) in a batch the earliest product, unless the URL was judged before; and one row if a page gave no product."""

    def init(self, handle) -> None:
        self.judged = handle.getMapState("judged", "visit string", "known boolean")

    def handleInputRows(self, key, rows, timerValues):
        first, failed = {}, {}
        for frame in rows:
            for visit, *row in frame[["visit", *ROW_NAMES]].itertuples(index=False, name=None):
                if row[2] == UNEXTRACTABLE:
                    failed[visit] = row
                elif visit not in first or row[1] < first[visit][1]:
                    first[visit] = row
        judged = _Known(self.judged)

        def unjudged():
            for visit, row in first.items():
                if visit not in judged:
                    if row[2] == BUILT:
                        judged.add(visit)
                    yield row

        yield from _frames(failed.values(), ROW_NAMES)
        yield from _frames(unjudged(), ROW_NAMES)


class FirstKey(StatefulProcessor):
    """Every row with `first`: it is the earliest complete product of its key, in this batch and before."""

    def init(self, handle) -> None:
        self.taken = handle.getMapState("taken", "dedup_key string", "known boolean")

    def handleInputRows(self, key, rows, timerValues):
        first = {}

        def later():
            for frame in rows:
                for row in frame[ROW_NAMES].itertuples(index=False, name=None):
                    if row[2] != BUILT or not row[5]:
                        yield (*row, False)
                        continue
                    held = first.get(row[4])
                    if held is None or row[1] < held[1]:
                        first[row[4]] = row
                        row = held
                    if row is not None:
                        yield (*row, False)

        taken = _Known(self.taken)

        def firsts():
            for claim, row in first.items():
                fresh = claim not in taken
                if fresh:
                    taken.add(claim)
                yield (*row, fresh)

        yield from _frames(later(), [*ROW_NAMES, "first"])
        yield from _frames(firsts(), [*ROW_NAMES, "first"])
