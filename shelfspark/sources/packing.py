"""Folders that collect small files, packed into fewer: readers see the folder before or after a packing, never between.

A packing writes its files to `_packed/data-…` and the files they stand for to `_packed/replaced-…`. It counts from the moment
its marker `_packed/N.done` exists; a run that is killed before leaves the folder as it was. The next number can be taken once,
so of two packings at the same time one fails. Files added meanwhile are untouched. Packed folders have to be read with
`read_packed`, since the files they replace go with `remove_replaced`.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import children, content, create_once, delete, has_data

TARGET = 128 << 20          # bytes of a packed file; files below half of it are packed
MOST_FILES = 10_000         # files per packing; the rest follows in the next one of the same call
_PLANNING = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


def _packings(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, id, are the replaced files still there) of every packing that counts."""
    names = set(children(spark, f"{path}/_packed"))
    done = sorted(int(n.removesuffix(".done")) for n in names if n.endswith(".done"))
    return [(n, content(spark, f"{path}/_packed/{n}.done"), f"{n}.removed" not in names) for n in done]


def _replaced(spark: SparkSession, path: str, packings: list) -> list[str]:
    """Files below `path` that packed ones stand for and that still lie there."""
    folders = [f"{path}/_packed/replaced-{at}" for _, at, there in packings if there]
    return [r.value for r in spark.read.text(folders).collect()] if folders else []


def read_packed(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """The rows of a folder, packed or not. Files that were replaced and not removed yet are pruned by their names."""
    path = path.rstrip("/")
    packings = _packings(spark, path)

    def load(*folders: str) -> DataFrame:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).format(fmt).load(list(folders))

    if not packings:
        return load(path)
    gone = sorted({name.rsplit("/", 1)[-1] for name in _replaced(spark, path, packings)})
    current = lambda df: df.filter(~F.col("_metadata.file_name").isin(gone)) if gone else df
    packed = current(load(*[f"{path}/_packed/data-{at}" for _, at, _ in packings]))
    schema = schema or packed.schema
    if not has_data(spark, path):
        return packed
    rest = current(load(path))
    return packed.unionByName(rest.select(*[c for c in rest.columns if c in packed.columns]), allowMissingColumns=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder has files, packed or not."""
    return has_data(spark, path) or bool(_packings(spark, path.rstrip("/")))


def _small_files(spark: SparkSession, path: str, target: int, keep: str | None) -> list[str]:
    """Paths below `path` of at most MOST_FILES small files that count; listed by Spark, which reads none of them."""
    packings = _packings(spark, path)
    folders = ([path] if has_data(spark, path) else []) + [f"{path}/_packed/data-{at}" for _, at, _ in packings]
    if not folders:
        return []
    files = None
    for folder in folders:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        files = listed if files is None else files.unionAll(listed)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    found = files.select(F.substr("path", F.lit(len(root) + 2)).alias("value"), "length").filter(F.col("length") < target // 2)
    gone = _replaced(spark, path, packings)
    if gone:
        found = found.filter(~F.col("value").isin(gone))
    if keep:
        found = found.filter(~F.startswith("value", F.lit(keep + "/")))
    return [r.value for r in found.orderBy("value").limit(MOST_FILES).collect()]


def pack(spark: SparkSession, path: str, target: int = TARGET, fmt: str = "parquet", keep: str | None = None, **options) -> int:
    """Pack the small files below `path` into files of about `target` bytes; returns how many were replaced.

    Spark's own scan puts small files together, so rows go from file to file without a shuffle. `fmt` is parquet, or text for
    files of lines. Partition folders become columns of parquet rows. `keep` names a folder to leave alone, such as one that may
    still be overwritten. Nothing happens with fewer than two small files.
    """
    path, total = path.rstrip("/"), 0
    planning = _PLANNING | {"spark.sql.files.maxPartitionBytes": str(target)}
    before = {key: spark.conf.get(key, None) for key in planning}
    while len(names := _small_files(spark, path, target, keep)) > 1:
        packings = _packings(spark, path)
        at = uuid.uuid4().hex
        roots = {f"{path}/_packed/data-{i}" for _, i, _ in packings if any(n.startswith(f"_packed/data-{i}/") for n in names)}
        roots |= {path} if any(not n.startswith("_packed/") for n in names) else set()
        rows = None
        for root in sorted(roots):
            mine = [f"{path}/{n}" for n in names if f"{path}/{n}".startswith(root + "/") and (root != path or not n.startswith("_packed/"))]
            part = spark.read.format(fmt).options(basePath=root, mergeSchema=True).load(mine)
            part = part.select("value") if fmt == "text" else part
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        try:
            for key, value in planning.items():
                spark.conf.set(key, value)
            rows.write.format(fmt).options(**options).save(f"{path}/_packed/data-{at}")
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.text(f"{path}/_packed/replaced-{at}")
        create_once(spark, f"{path}/_packed/{max((n for n, _, _ in packings), default=0) + 1}.done", at)
        total += len(names)
        if len(names) < MOST_FILES:
            break
    return total


def remove_replaced(spark: SparkSession, path: str) -> int:
    """Delete the files that packed ones stand for; returns how many. Call it when no reader from before the packing is left."""
    path, total = path.rstrip("/"), 0
    for number, at, there in _packings(spark, path):
        if not there:
            continue
        names = _replaced(spark, path, [(number, at, there)])
        for name in names:
            delete(spark, f"{path}/{name}")
        create_once(spark, f"{path}/_packed/{number}.removed", "")
        total += len(names)
    return total
