"""Session settings. ``build`` is for local runs; on a cluster call ``tune`` on the given session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every job here assumes.
RUNTIME_CONF = {
    # Times are UTC throughout.
    "spark.sql.session.timeZone": "UTC",
    # A projection holding dozens of rule predicates compiles to one method the JVM refuses to
    # JIT (over 8000 bytes of bytecode). Above this size Spark splits the projection instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(cpus: int | str = "*", app: str = "embertrace", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local session without one
    (tests) gets a temporary folder; on a cluster that would be another folder on each machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        path = tempfile.mkdtemp(prefix="embertrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on any store that Spark reaches."""
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern``, on any store that Spark reaches; none if there are none."""
    fs, at = _hadoop(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(at) or []]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library itself made and no longer needs."""
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole under its name; an error if there is one already."""
    fs, at = _hadoop(spark, path)
    made = at.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(made)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(made, at):
        fs.delete(made, False)
        raise FileExistsError(path)


def cut_lineage(df):
    """Materialise ``df`` in the shared folder so lost executors never force a long replay."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
