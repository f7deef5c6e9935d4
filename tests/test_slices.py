import gc

import pyarrow as pa
import pytest

from shelfspark.operators import match
from shelfspark.operators.match import Field, match_selectors, slices


class Pages:
    """Stands for a DataFrame and hands the Arrow pass out."""

    def __init__(self, spark, columns):
        self.schema = spark.createDataFrame([], columns).schema

    def select(self, *names):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_nodes_of_a_few_pages_are_held_at_a_time(spark):
    work = match_selectors(Pages(spark, "id int, html string"), [Field("h", "h1", text=True)])
    html = [None if i % 7 == 0 else f"<h1>{i}</h1>" + "<i>" * (i % 50) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int32()), pa.array(html, pa.string())], ["id", "html"])
    out = list(work(iter([batch])))
    assert max(part.num_rows for part in out) <= match.SLICE_PAGES
    rows = [row for part in out for row in part.to_pylist()]
    assert rows == [{"id": i, "h": [] if i % 7 == 0 else [{"alt": 0, "text": str(i)}]} for i in range(5000)]
    assert list(work(iter([batch.slice(0, 0)]))) == []


def test_slices_keep_all_rows_and_end_at_their_bytes():
    sizes = [10, match.SLICE_BYTES, 5, match.SLICE_BYTES // 2, match.SLICE_BYTES // 2, 3 * match.SLICE_BYTES, 0, 7]
    for kind in (pa.string(), pa.binary(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in sizes], pa.binary()).cast(kind)], ["html"])
        parts = [[len(v) for v in part.column("html").to_pylist()] for part in slices(batch, "html")]
        assert [n for part in parts for n in part] == sizes
        assert all(sum(part) <= match.SLICE_BYTES or len(part) == 1 for part in parts)


def test_no_collection_while_the_nodes_of_a_slice_are_held(spark):
    work = match_selectors(Pages(spark, "id int, html string"), [Field("h", "i", text=True)])
    html = ["<i>a</i>" * 400] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int32()), pa.array(html, pa.string())], ["id", "html"])
    runs = []
    count = lambda phase, info: runs.append(phase)
    gc.collect()
    gc.callbacks.append(count)
    try:
        parts = work(iter([batch]))
        assert sum(part.num_rows for part in parts) == 300
    finally:
        gc.callbacks.remove(count)
    assert len(runs) <= 4 and gc.isenabled()


def test_collection_is_on_again_after_a_failure_and_stays_off_where_it_was():
    with pytest.raises(ValueError), match.uncollected():
        assert not gc.isenabled()
        raise ValueError
    assert gc.isenabled()
    gc.disable()
    try:
        with match.uncollected():
            pass
        assert not gc.isenabled()
    finally:
        gc.enable()
