"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lexmill", cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session of one machine, as in tests, may go without: it gets a temporary
    one; on a cluster no executor could read what another wrote there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def step_path(spark: SparkSession, name: str) -> str:
    """A new path for a step's table."""
    return f"{shared_dir(spark)}/lexmill-{os.getpid()}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def until_end(spark: SparkSession, *paths: str) -> None:
    """Has the driver delete these folders when it ends."""
    for path in paths:
        p, files = _folder(spark, path)
        files.deleteOnExit(p)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df once to the shared folder and reads it back, so what follows neither repeats the work
    nor depends on an executor that may be lost. The table is there until it is released or the driver ends."""
    path = step_path(df.sparkSession, name)
    df.write.parquet(path)
    until_end(df.sparkSession, path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._step = path
    return got


def release(df: DataFrame) -> None:
    """Deletes the table behind a materialised df that nothing reads any more."""
    if path := getattr(df, "_step", None):
        p, files = _folder(df.sparkSession, path)
        files.delete(p, True)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table. One that is a single file smaller than a split, which would keep all but one core idle, is spread
    by key: at most a split is ever shuffled, and tables of several files are read as they lie."""
    df = spark.read.parquet(path)
    if len(df._jdf.inputFiles()) > 1:  # counted in the JVM: a large table has many
        return df
    p, files = _folder(spark, path)
    size = files.getContentSummary(p).getLength()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism, key) if 1 << 20 < size < split else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, wherever they run; once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexmill-ship-"), "lexmill_shipped.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
