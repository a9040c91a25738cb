"""Session factory and table loader used by tests, the bench and the driver entry point."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE on, Arrow on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("notewright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver share (spark.checkpoint.dir).

    Only a local master may do without: it gets a temporary folder for its JVM. On a cluster a machine's own folder would lose
    what other machines read, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(sc, "_notewright_dir"):
        sc._notewright_dir = f"file://{tempfile.mkdtemp(prefix='notewright-')}"
        delete_on_exit(spark, sc._notewright_dir)
    return sc._notewright_dir


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def materialise(d: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``d`` as a table of the shared folder and read it back; it goes when the driver's JVM ends, or by ``discard``.

    A lost executor then costs no recomputation, loops keep short plans, and what two readers see is the same.
    """
    spark = d.sparkSession
    path = f"{shared_dir(spark)}/notewright/{name}-{uuid.uuid4().hex}"
    d.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(d.schema).parquet(path)
    out._notewright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing will read again."""
    for d in tables:
        p, fs = _path(d.sparkSession, d._notewright_path)
        fs.delete(p, True)
