"""Does a path exist, asked of the file system that owns it (local, HDFS or object store)."""

from pyspark.sql import SparkSession


def has_data(spark: SparkSession, path: str) -> bool:
    """True if `path` is a file, or a folder with at least one entry that is not hidden."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return False
    if fs.getFileStatus(target).isFile():
        return True
    entries = fs.listStatusIterator(target)
    while entries.hasNext():
        if not entries.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it is absent."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def create_once(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file that must not exist yet; fails where another writer made it first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; an absent one is no fault."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def content(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).head()[0]
