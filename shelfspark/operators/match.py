"""Selector match: pages -> matched nodes, in one Arrow pass over the HTML.

This is the only place where rows leave the JVM. Each configured field becomes one array column
of small structs, so everything after it is built-in expressions and `html` can be dropped here.
"""

import ctypes
import gc
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import constants as C
from . import html_nodes, selectors as css

# Ship the helpers with the task, so executors do not need this package installed.
for _module in (sys.modules[__name__], html_nodes, css):
    cloudpickle.register_pickle_by_value(_module)


#: Bytes and pages whose nodes a Python worker holds at a time.
SLICE_BYTES, SLICE_PAGES = 1 << 20, 512


@dataclass(frozen=True)
class Field:
    """What to keep of the nodes that match `selectors`.

    `first` keeps the first node of each alternative; `group` treats the commas as one CSS group,
    so a node that matches twice counts once.
    """

    name: str
    selectors: str
    text: bool = False
    attrs: tuple[str, ...] = ()
    cells: bool = False
    first: bool = False
    group: bool = False


def detail_fields(selectors: dict = C.DETAIL_SELECTORS) -> list[Field]:
    def one_text(name):
        return Field(name, selectors[name], text=True, first=True)

    return [
        one_text("name"),
        one_text("brand"),
        Field("sku", selectors["sku"], text=True, attrs=("data-sku",), first=True),
        one_text("price"),
        one_text("description"),
        one_text("pack_size"),
        Field("availability", selectors["availability"], attrs=("href", "class")),
        Field("images", selectors["images"], attrs=("src", "data-src", "data-lazy-src")),
        Field("specifications_rows", selectors["specifications_rows"], cells=True),
        Field("breadcrumbs", selectors["breadcrumbs"], text=True),
    ]


def listing_fields(selectors: dict = C.LISTING_SELECTORS) -> list[Field]:
    return [
        Field("product_link", selectors["product_link"], attrs=("href", "content")),
        Field("next_page", selectors["next_page"], attrs=("href",), first=True),
    ]


def page_type_fields(
    detail_signal: str = C.DETAIL_SIGNAL,
    title: str = C.DETAIL_TITLE,
    listing_signal: str = C.LISTING_SIGNAL,
    cards: str = C.LISTING_CARDS,
) -> list[Field]:
    return [
        Field("detail_signal", detail_signal, first=True),
        Field("detail_title", title, first=True, group=True),
        Field("listing_signal", listing_signal, first=True),
        Field("listing_cards", cards, group=True),
    ]


def _hit_type(field: Field) -> T.StructType:
    parts = [T.StructField("alt", T.IntegerType(), False)]
    if field.text:
        parts.append(T.StructField("text", T.StringType()))
    parts += [T.StructField(a.replace("-", "_"), T.StringType()) for a in field.attrs]
    if field.cells:
        parts.append(T.StructField("cells", T.ArrayType(T.StringType())))
    return T.StructType(parts)


def _hit_column(field: Field, pages: list) -> pa.ListArray:
    offsets, records = [0], []
    for hits in pages:
        records += hits
        offsets.append(len(records))
    names, columns = ["alt"], [pa.array([r[0] for r in records], pa.int32())]
    if field.text:
        names.append("text")
        columns.append(pa.array([r[1] for r in records], pa.string()))
    for i, a in enumerate(field.attrs):
        names.append(a.replace("-", "_"))
        columns.append(pa.array([r[2][i] for r in records], pa.string()))
    if field.cells:
        names.append("cells")
        columns.append(pa.array([r[3] for r in records], pa.list_(pa.string())))
    nodes = pa.StructArray.from_arrays(columns, names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def page_texts(column: pa.Array) -> list[str]:
    """The pages of a text or binary column; a null page is empty, and bytes that are no UTF-8 become replacement characters."""
    return ["" if page is None else page.decode("utf-8", "replace") for page in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about SLICE_BYTES of pages; a longer page is a slice of its own."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(html).cast(pa.binary())), 0).to_pylist()
    for row, length in enumerate(lengths):
        if row > start and (size + length > SLICE_BYTES or row - start == SLICE_PAGES):
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length
    if start < len(lengths):
        yield batch.slice(start)


@contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collection meanwhile: the nodes of a slice hold no cycles, and looking for some takes about a quarter of the match."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def match_selectors(pages: DataFrame, fields: list[Field], html: str = "html") -> DataFrame:
    """Replace the `html` column by one array<struct<alt, ...>> column per field.

    Arrays are in selector order, then document order. A null page has no hits. Damaged pages are read as `page_texts` says.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(kept + [T.StructField(f.name, T.ArrayType(_hit_type(f)), False) for f in fields])
    kept_names = [f.name for f in kept]
    specs, alternatives = [], []
    for i, f in enumerate(fields):
        alts = css.split_selectors(f.selectors)
        specs.append((len(alts), f.text, f.attrs, f.cells, f.first, f.group))
        alternatives += [(i, j, css.compile_selector(s)) for j, s in enumerate(alts)]
    names = kept_names + [f.name for f in fields]
    index = html_nodes.SelectorIndex(alternatives)
    match_page, hit_column, texts = html_nodes.match_page, _hit_column, page_texts
    cut, give_back, without_gc = slices, release, uncollected

    def match_slice(part):
        with without_gc():
            pages_hits = [match_page(page, index, specs) for page in texts(part.column(html))]
            columns = [part.column(n) for n in kept_names]
            columns += [hit_column(f, [p[i] for p in pages_hits]) for i, f in enumerate(fields)]
            return pa.RecordBatch.from_arrays(columns, names)

    def match_batches(batches):
        for batch in batches:
            for part in cut(batch, html):
                yield match_slice(part)
            give_back()

    return pages.select(html, *kept_names).mapInArrow(match_batches, schema)
