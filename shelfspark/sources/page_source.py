"""Page files as a Spark data source, `shelf_pages`: batch and stream, split by row groups, filters on columns pushed to the files.

    register_page_source(spark)
    spark.read.format("shelf_pages").load("…/pages").filter("url = 'https://…'")
    spark.readStream.format("shelf_pages").load("…/pages")

A folder of parquet files on any file system that pyarrow knows and all executors reach. A row group whose statistics rule a
pushed filter out is not read.
"""

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register_page_source(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark offer it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time of the last change, name, size) of the data files, oldest first."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda name: any(part.startswith(("_", ".")) for part in name[len(at):].split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden(f.path))


@dataclass
class RowGroups(InputPartition):
    """Some row groups of one file."""

    file: str
    first: int
    last: int


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelf_pages"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError("no page files there: give a schema")
        return from_arrow_schema(pq.read_schema(files[0][1], filesystem=_opened(self.options["path"])[0]))

    def reader(self, schema: StructType) -> "PageReader":
        return PageReader(self.options, schema)

    def streamReader(self, schema: StructType) -> "PageStreamReader":
        return PageStreamReader(self.options, schema)


class _Files:
    """Reading of row groups, shared by batch and stream."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.shape = to_arrow_schema(schema)
        self.groups = int(options.get("rowGroupsPerTask", 1))
        self.wanted: list[tuple[str, list]] = []

    def _split(self, files: list[str]) -> list[RowGroups]:
        out, fs = [], _opened(self.path)[0]
        for file in files:
            n = pq.read_metadata(file, filesystem=fs).num_row_groups
            out += [RowGroups(file, lo, min(lo + self.groups, n)) for lo in range(0, n, self.groups)]
        return out

    def _possible(self, group: pq.RowGroupMetaData) -> bool:
        statistics = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for name, values in self.wanted:
            known = statistics.get(name)
            if known is not None and known.has_min_max and not any(known.min <= v <= known.max for v in values):
                return False
        return True

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(partition.file, filesystem=_opened(self.path)[0]) as opened:
            known = [c for c in self.columns if c in opened.schema_arrow.names]
            for n in range(partition.first, partition.last):
                if not self._possible(opened.metadata.row_group(n)):
                    continue
                for batch in opened.iter_batches(batch_size=1000, row_groups=[n], columns=known):
                    for name, values in self.wanted:
                        batch = batch.filter(pc.is_in(batch.column(name), pa.array(values, batch.schema.field(name).type)))
                    # A column that this file lacks is null.
                    columns = [batch.column(f.name).cast(f.type) if f.name in known else pa.nulls(len(batch), f.type) for f in self.shape]
                    yield pa.RecordBatch.from_arrays(columns, schema=self.shape)


class PageReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes `column = value` and `column in (values)` on text and whole numbers; Spark applies the others, and null tests too."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else []
            if values and len(f.attribute) == 1 and all(type(v) in (str, int) for v in values):
                self.wanted.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self) -> list[RowGroups]:
        return self._split([name for _, name, _ in _files(self.path)])


class PageStreamReader(_Files, DataSourceStreamReader):
    """An offset is the newest file taken so far, by time and name; files are complete when they appear."""

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return self._split([name for at, name, _ in _files(self.path) if low < (at, name) <= high])

    def commit(self, end: dict) -> None:
        json.dumps(end)
