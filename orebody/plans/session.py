"""Sessions, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine, with a folder of its own for written tables."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orebody")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="orebody-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is not set, a temporary one, if all tasks run on this machine: on a
    cluster no folder of one machine will do, so there the setting is required."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_orebody_folder", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orebody-")
        spark._orebody_folder = named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there is removed by release, or when the application ends."""
    own = getattr(spark, "_orebody_own", None)
    if own is None:
        own = spark._orebody_own = f"{shared_folder(spark)}/application-{uuid.uuid4().hex}"
        at, system = _system(spark, own)
        system.mkdirs(at)
        system.deleteOnExit(at)
        spark._orebody_written = []
    path = f"{own}/{what}-{uuid.uuid4().hex}"
    spark._orebody_written.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI that names its file system, for readers outside of Spark."""
    at, system = _system(spark, path)
    uri = system.makeQualified(at).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder once and read it back: cuts the lineage, and survives the loss of executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many paths have been given out: a mark for release."""
    return len(getattr(spark, "_orebody_written", []))


def release(spark: SparkSession, mark: int = 0) -> None:
    """Remove the tables written since the mark. Frames that read them cannot be used any more."""
    paths = getattr(spark, "_orebody_written", [])
    for path in paths[mark:]:
        at, system = _system(spark, path)
        system.delete(at, True)
    del paths[mark:]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
