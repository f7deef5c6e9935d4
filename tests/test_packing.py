import pytest
from pages import SELECTORS_B
from test_stream import TS, arrivals

from shelfspark.operators import metrics
from shelfspark.sources import packing, page_state
from shelfspark.sources import pages as page_tables
from shelfspark.streaming.catalog import judged_rows, pack_stream, stream_catalog, stream_products


def rows_of(df):
    return sorted(map(tuple, df.select("url", "html").collect()), key=repr)


def files(folder):
    return [f for f in folder.rglob("part-*") if f.name.startswith("part-")]


def add(spark, archive, lo, hi, parts=5):
    rows = spark.createDataFrame([(f"https://h/{i}", f"<p>{i}") for i in range(lo, hi)] + [(None, None)], "url string, html string")
    page_tables.write_archive(page_tables.as_pages(rows.repartition(parts)), archive)


def test_an_archive_reads_the_same_before_during_and_after(spark, tmp_path, monkeypatch):
    archive = str(tmp_path / "my archive")
    for lo in (0, 10, 20):
        add(spark, archive, lo, lo + 10)
    before = rows_of(page_tables.read_archive(spark, archive))
    assert len(before) == 33

    # Killed before its marker: the old state, and the next packing starts anew.
    def killed(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(packing, "create_once", killed)
        with pytest.raises(RuntimeError):
            page_tables.pack_archive(spark, archive)
    assert rows_of(page_tables.read_archive(spark, archive)) == before

    n = len(files(tmp_path / "my archive")) - len(files(tmp_path / "my archive" / "_packed"))
    assert page_tables.pack_archive(spark, archive) == n
    assert rows_of(page_tables.read_archive(spark, archive)) == before
    assert page_tables.pack_archive(spark, archive) == 0            # one packed file is left, nothing to do
    assert packing.remove_replaced(spark, archive) == n
    assert rows_of(page_tables.read_archive(spark, archive)) == before
    assert not [f for f in (tmp_path / "my archive").iterdir() if f.name.startswith("part-")]

    add(spark, archive, 30, 40)
    after = rows_of(page_tables.read_archive(spark, archive))
    assert len(after) == 44
    page_tables.pack_archive(spark, archive)
    packing.remove_replaced(spark, archive)
    assert rows_of(page_tables.read_archive(spark, archive)) == after
    assert [r.html for r in page_tables.read_archive(spark, archive, "https://h/33").collect()] == ["<p>33"]
    assert packing.remove_replaced(spark, archive) == 0


def test_packed_files_have_the_target_size_and_all_rounds_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "MOST_FILES", 4)
    archive = str(tmp_path / "a")
    add(spark, archive, 0, 60, parts=11)
    before = rows_of(page_tables.read_archive(spark, archive))
    size = max(f.stat().st_size for f in files(tmp_path / "a"))
    assert page_tables.pack_archive(spark, archive, target=3 * size) >= 11
    packing.remove_replaced(spark, archive)
    kept = [f for f in files(tmp_path / "a" / "_packed") if "replaced-" not in str(f)]
    assert 2 <= len(kept) < 11
    assert rows_of(page_tables.read_archive(spark, archive)) == before


def test_two_packings_at_once_do_not_double_rows(spark, tmp_path, monkeypatch):
    archive = str(tmp_path / "a")
    add(spark, archive, 0, 10)
    before = rows_of(page_tables.read_archive(spark, archive))
    first = packing.create_once

    def other_wins(session, path, text):
        monkeypatch.setattr(packing, "create_once", first)
        page_tables.pack_archive(spark, archive)
        first(session, path, text)

    monkeypatch.setattr(packing, "create_once", other_wins)
    with pytest.raises(Exception, match="exist"):
        page_tables.pack_archive(spark, archive)
    assert rows_of(page_tables.read_archive(spark, archive)) == before


def test_a_packed_stream_goes_on(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    def arrive(lo, hi):
        arrivals(spark, [(i, f"http://h/{i}", f"S{i}") for i in range(lo, hi)]).repartition(2).write.mode("append").parquet(src)
        stream_catalog(spark, src, out, TS, SELECTORS_B, files_per_batch=1)

    arrive(0, 6)
    arrive(6, 10)
    judged, products = sorted(judged_rows(spark, out).collect()), sorted(r.sku for r in stream_products(spark, out).collect())
    assert len(judged) == len(products) == 10
    assert pack_stream(spark, out) > 0
    assert sorted(judged_rows(spark, out).collect()) == judged
    for name in ("judged", "products", "gate_rejects", "unextractable"):
        packing.remove_replaced(spark, f"{out}/{name}")
    assert sorted(judged_rows(spark, out).collect()) == judged
    assert sorted(r.sku for r in stream_products(spark, out).collect()) == products
    assert len({r.batch_id for r in judged}) == 4
    arrive(8, 12)
    assert judged_rows(spark, out).count() == 12 and stream_products(spark, out).count() == 12


def crawl(spark, pages):
    return spark.createDataFrame(pages, "url string, html string")


def test_page_state_follows_the_crawls(spark, tmp_path):
    path = str(tmp_path / "state")
    found = lambda df: {r.url: (r.first_seen, r.changed_at, r.seen_at, r.version) for r in df.collect()}
    assert page_state.load_page_state(spark, path).count() == 0
    first = crawl(spark, [("a", "1"), ("b", "1"), ("c", None), (None, "x")])
    assert set(found(page_state.merge_page_state(first, path, "t1", buckets=8))) == {"a", "b", "c"}
    # Equal, changed, gone to null and back, new, twice in one crawl.
    second = crawl(spark, [("a", "1"), ("b", "2"), ("c", None), ("d", "1"), ("d", "1")])
    assert set(found(page_state.merge_page_state(second, path, "t2"))) == {"b", "d"}
    assert set(found(page_state.merge_page_state(second, path, "t3"))) == set()
    assert set(found(page_state.merge_page_state(crawl(spark, [("c", "now"), ("b", None)]), path, "t4"))) == {"b", "c"}
    assert found(page_state.load_page_state(spark, path)) == {
        "a": ("t1", "t1", "t3", 1), "b": ("t1", "t4", "t4", 4), "c": ("t1", "t4", "t4", 4), "d": ("t2", "t2", "t3", 2)}
    assert page_state.merge_page_state(crawl(spark, []), path, "t5").count() == 0
    before = found(page_state.load_page_state(spark, path))
    assert page_state.drop_old_versions(spark, path) > 0 and page_state.drop_old_versions(spark, path) == 0
    assert found(page_state.load_page_state(spark, path)) == before


def test_a_merge_rewrites_touched_buckets_only_and_a_killed_one_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    page_state.merge_page_state(crawl(spark, [(f"u{i}", "1") for i in range(200)]), path, "t1", buckets=16)
    _, _, folders = page_state._current(spark, path)
    assert len(folders) == 16
    with monkeypatch.context() as patch:
        patch.setattr(page_state, "create_once", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            page_state.merge_page_state(crawl(spark, [("u1", "2")]), path, "t2")
    assert page_state._current(spark, path)[2] == folders
    changed = page_state.merge_page_state(crawl(spark, [("u1", "2")]), path, "t2")
    assert [r.url for r in changed.collect()] == ["u1"]
    later = page_state._current(spark, path)[2]
    assert sum(later[b] != folders[b] for b in folders) == 1
    assert page_state.load_page_state(spark, path).count() == 200


def test_archived_pages_are_not_hashed_again(spark, tmp_path):
    archive = str(tmp_path / "a")
    add(spark, archive, 0, 10)
    pages = page_tables.read_archive(spark, archive)
    known = metrics.page_hashes(pages.filter("url <> 'https://h/3'"))
    changed = metrics.changed_pages(pages, known)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and sum("FileScan" in line and "html:string" in line for line in plan.splitlines()) == 1
    assert {r.url for r in changed.collect()} == {"https://h/3", None}
