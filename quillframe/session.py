"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job here relies on. They are only ever *set*, never
#: lowered: partition counts and memory stay whatever the cluster chose.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # JSON written for array/object fields keeps its null members.
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    # Whole documents go to Python workers: bound a batch by bytes, not rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "quillframe", **conf: str) -> SparkSession:
    """A session for scripts and notebooks; extra settings come as keywords
    with dots replaced by double underscores (``spark__executor__memory``)."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillframe-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))  # copied to every executor


_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, it is a folder of the warehouse, which executors share
    with the driver by definition. No machine-local folder is ever used.
    """
    folder = spark.conf.get(SHARED_DIR_CONF, None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillframe_scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder, deleted when Python ends
    or by :func:`release_scratch`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(release_scratch)
    _scratch.append((spark.sparkContext, path))
    return path


_scratch: list[tuple[SparkContext, str]] = []


def release_scratch() -> None:
    """Delete the stored intermediates of this program. Results that still read
    them must have been written or collected."""
    while _scratch:
        context, path = _scratch.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone already
            jvm = context._gateway.jvm
            jpath = jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(jpath, True)


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where a result must not change on recomputation (partition ids, user
    code) or is read several times. The table survives lost executors, and a
    reader of it still prunes columns, pushes filters and, with
    ``partition_by``, skips whole partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
