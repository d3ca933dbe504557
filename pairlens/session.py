"""Session factory and table loading."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "pairlens", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and bench use; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``; reads through Spark only, so any file system does."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for rows that cost much each: some for every core, and no fewer than a shuffle has. A small file is one task otherwise."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_out(df: DataFrame) -> DataFrame:
    """df in spread() partitions, before work that costs much for each row; for narrow rows, which this shuffles once."""
    return df.repartition(spread(df.sparkSession))


def scratch(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new path in the folder that all executors share; a temporary folder only for a local session without one. Unless ``kept``, it goes with the driver."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pairlens-")
    path = f"{folder}/pairlens/{name}-{uuid.uuid4().hex}"
    if kept:
        return path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that all executors share, read again: computed once, and no longer dependent on what it came from."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pairlens_path = path
    return out


def bucketed(df: DataFrame, name: str, n: int, keys: list[str]) -> DataFrame:
    """stored(), in n buckets of its keys: groups of these keys are read where they lie, without another shuffle. df comes dealt out by the keys."""
    path, table = scratch(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._pairlens_path, out._pairlens_table = path, table
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of stored() or bucketed() that nothing reads any more."""
    spark = table.sparkSession
    if found := getattr(table, "_pairlens_table", None):
        spark.sql(f"DROP TABLE `{found}`")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._pairlens_path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(where, True)
    system.cancelDeleteOnExit(where)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled goes when the query ends; else it stays on the executors' disks until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
