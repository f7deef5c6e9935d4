import pandas as pd

from shelfspark.streaming import known


class Store:
    """Map state of one bucket; counts the lookups by key."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def updateValue(self, key, value):
        self.held[key] = value


def run(processor, store, rows, names):
    processor.init(store)
    frames = [pd.DataFrame(rows[i:i + 2], columns=names) for i in range(0, len(rows), 2)]
    out = list(processor.handleInputRows((0,), iter(frames), None))
    return out, sorted(tuple(r) for frame in out for r in frame.itertuples(index=False, name=None))


def row(url, place, status=known.BUILT, key="k", complete=True):
    return (url, place, status, None, key, complete, "{}")


def test_one_call_takes_all_visits_of_a_bucket():
    rows = [row("a", "3"), row("a", "1"), row("b", "2"), row("c", "4", known.UNEXTRACTABLE), row("d", "5", known.GATED), row("c", "6")]
    store, names = Store(), ["visit", *known.ROW_NAMES]
    _, found = run(known.FirstVisit(), store, [(r[0], *r) for r in rows], names)
    assert [(r[0], r[1]) for r in found] == [("a", "1"), ("b", "2"), ("c", "4"), ("c", "6"), ("d", "5")]
    assert store.asked == 0 and set(store.held) == {("a",), ("b",), ("c",)}
    # Judged ones are out; a gated one is not judged yet; rows without a product come again.
    _, again = run(known.FirstVisit(), store, [("a", *row("a", "0")), ("d", *row("d", "7")), ("c", *row("c", "8", known.UNEXTRACTABLE))], names)
    assert [(r[0], r[1]) for r in again] == [("c", "8"), ("d", "7")]
    assert store.asked == 2


def test_one_call_takes_all_keys_of_a_bucket():
    rows = [row("a", "2", key="x"), row("b", "1", key="x"), row("c", "3", key="y"), row("d", "4", key="x", complete=False), row("e", "5", known.GATED, None)]
    store = Store()
    _, found = run(known.FirstKey(), store, rows, known.ROW_NAMES)
    assert [(r[0], r[-1]) for r in found] == [("a", False), ("b", True), ("c", True), ("d", False), ("e", False)]
    _, again = run(known.FirstKey(), store, [row("f", "0", key="y"), row("g", "1", key="z")], known.ROW_NAMES)
    assert [(r[0], r[-1]) for r in again] == [("f", False), ("g", True)]


def test_rows_leave_in_frames_of_many():
    many = [row(f"u{i}", f"{i:05}", key=f"k{i}") for i in range(known.SENT + 1)]
    out, found = run(known.FirstKey(), Store(), many, known.ROW_NAMES)
    assert [len(frame) for frame in out] == [known.SENT, 1] and len(found) == len(many)
