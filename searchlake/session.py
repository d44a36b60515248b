"""Session settings and the shared folder that jobs cut their lineage in."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []
_kept: list[str] = []


def build_session(app: str = "searchlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` adds to or replaces them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",  # very long texts make small batches
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    A folder of this machine is made only where the setting is missing and the session is
    local, as in tests; a cluster without the setting is an error, because a folder that
    the executors don't share can't survive the loss of one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    folder = context.getCheckpointDir()
    if folder:
        return folder.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="searchlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends, or by drop_scratch()."""
    if not _made and not _kept:
        atexit.register(_drop_at_exit)
    _made.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_at_exit(path: str) -> None:
    """Remove a path of the shared folder when the driver ends, but not in drop_scratch()."""
    if not _made and not _kept:
        atexit.register(_drop_at_exit)
    _kept.append(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the paths that scratch_path() gave out. Frames that read them can't be used afterwards."""
    java = spark.sparkContext._jvm
    while _made:
        path = java.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame from materialize(), which nothing reads any more."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        given = next((m for m in _made if path.endswith(m.partition(":")[2] or m) or m.endswith(path)), None)
        if given:
            files, at = _at(df.sparkSession, given)
            files.delete(at, True)
            _made.remove(given)


def table_version(spark: SparkSession, folder: str, name: str) -> str:
    """A table's path with the time and size of its files: another one when the table was written anew."""
    files, at = _at(spark, f"{folder}/{name}.parquet")
    return f"{folder}/{name} {files.getFileStatus(at).getModificationTime()} {files.getContentSummary(at).getLength()}"


def _drop_at_exit() -> None:
    try:
        if (spark := SparkSession.getActiveSession()) is not None:
            _made.extend(_kept)
            drop_scratch(spark)
    except Exception:  # the JVM may be gone already; then the files stay
        pass


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it again: the lineage ends at the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Split a frame of fewer partitions than cores before a CPU-heavy Python stage.

    A large input has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(per_core * cores)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A folder of one text file with a few lines, as a job would leave it; the driver writes it by itself."""
    files, at = _at(spark, path)
    files.delete(at, True)
    for name, text in (("part-00000.txt", "".join(f"{x}\n" for x in lines)), ("_SUCCESS", "")):
        out = files.create(_at(spark, f"{path}/{name}")[1])
        out.write(bytearray(text.encode()))
        out.close()


def save_path_of(spark: SparkSession, label: str, lines: list[str]) -> str:
    """A path in the shared folder with the given lines of text."""
    path = scratch_path(spark, label)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path
