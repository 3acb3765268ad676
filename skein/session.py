"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CUTS: dict[str, SparkSession] = {}


def get_spark(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    A session that names none gets a private one only on a local master, where the driver is the executor; on a cluster a
    folder of one machine would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that last as long as the program."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    _CUTS[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that its lineage ends there.

    Unlike ``checkpoint()`` this runs the plan once, keeps the rows columnar, and survives a lost executor.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Deletes the table behind a :func:`cut` that nothing needs any more."""
    path = getattr(df, "_skein_path", None)
    if path and _CUTS.pop(path, None):
        _delete(df.sparkSession, path)


@atexit.register
def _clean_up() -> None:
    for path in list(_CUTS):
        spark = _CUTS.pop(path)
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def data_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
