"""Session settings and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.  Shuffle width is left to
# AQE: it starts from spark.sql.shuffle.partitions and coalesces by bytes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pages are large rows: small Arrow batches keep Python workers bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(app: str = "siteatlas", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (time zone) and the bounded batches, and ship the package to the workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Python workers import this package by name: send it along, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="siteatlas-"), "siteatlas.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)


# Folder made up for a local application whose session names none.
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local master may go without: there, and nowhere else, a temporary
    folder is made up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        if context.applicationId not in _OWN_DIR:
            _OWN_DIR[context.applicationId] = tempfile.mkdtemp(prefix="siteatlas-")
        named = _OWN_DIR[context.applicationId]
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def run_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate files; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/siteatlas-{spark.sparkContext.applicationId}"
    files, where = _file_system(spark, folder)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files outlive lost executors, unlike blocks held by them, and the
    reader sees file sizes, so joins on it are planned with real statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Drop the files behind a ``cut_lineage`` result that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        files, where = _file_system(df.sparkSession, path)
        files.delete(where, True)
