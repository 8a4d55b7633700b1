"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every plan here relies on."""
    # Calendar functions and timestamp parsing are defined in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Several plans join on an order key and then group by it without a second shuffle. When one
    # order is hot, splitting its join partition is worth the shuffle that this costs.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def configure_tables(spark: SparkSession) -> SparkSession:
    """``configure``, and tasks whose rows can be sorted in memory.

    The first row of a key is found by a sort in each task before the shuffle. A part of a file grows several times over
    as rows, and a sort that does not fit is written out and read again.
    """
    configure(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
    # The JVM never compiles a longer method: rules over many columns would be interpreted, row after row. Spark then
    # cuts the work into several.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: int | str = 8, memory: str = "16g", name: str = "mercato") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """This application's part of the folder shared by all executors (spark.checkpoint.dir)."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="mercato-")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the work folder that nothing else uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the writer, and read it back.

    The result has no lineage beyond files that outlive any executor, and Spark knows its size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with its files, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def written_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written`` as long as the block lasts, which must end every read of it: then the files are removed."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


class Stages:
    """Scratch tables one after another: each is made from the one before, which then goes. The last goes with ``close``."""

    def __init__(self, name: str):
        self.name, self._held = name, ExitStack()

    def __call__(self, df: DataFrame) -> DataFrame:
        before, self._held = self._held, ExitStack()
        with before:
            return self._held.enter_context(written_meanwhile(df, self.name))

    def close(self) -> None:
        self._held.close()


_REMOVE_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark removes what a query has shuffled as soon as the query ends.

    Otherwise those files stay until the driver's garbage collector comes across them, which a large heap puts off: several
    writes one after another would then hold the disk of all.
    """
    before = spark.conf.get(_REMOVE_SHUFFLED)
    spark.conf.set(_REMOVE_SHUFFLED, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLED, before)
