"""Session factory, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "bohagi", cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one of its own; on a cluster that is an error, since a machine-local folder is lost with it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.applicationId not in _own_dirs:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="bohagi-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def clear() -> None:
    """Removes every table and folder written so far by materialize and scratch. A long session calls it once the
    results of its queries have been read; when Python exits it runs by itself."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over; the folder's owner removes the rest
            pass


atexit.register(clear)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the tables."""
    path = f"{shared_dir(spark)}/bohagi/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a
    lost executor costs only the tasks that read it. Columns keep their names and types."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
