"""Incremental evaluation (R1-R7): a keyed result cache that micro-batches fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.constraints import ConstraintError, duplicate_keys


def pending(rows: DataFrame, cache: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """Rows without a cached result of the same key and the same version columns (such as code and timeout)."""
    return rows.join(cache.select(*keys, *versions).distinct(), [*keys, *versions], "left_anti")


def reusable(rows: DataFrame, cache: DataFrame, keys: list[str], versions: list[str], order: str) -> DataFrame:
    """R2: cached results that still hold for rows; of several the last by order."""
    latest = Window.partitionBy(*keys, *versions).orderBy(F.col(order).desc())
    own = cache.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return rows.select(*keys, *versions).join(own, [*keys, *versions])


def corrected(rows: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with some values replaced by key."""
    new = corrections.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def reject_duplicates(batch: DataFrame, seen: DataFrame, keys: list[str]) -> None:
    """A key that stands twice in a batch, or was seen before, raises."""
    found = duplicate_keys(batch, keys).limit(1).collect() or batch.join(seen.select(*keys), keys, "left_semi").limit(1).collect()
    if found:
        raise ConstraintError(f"key seen twice: {found[0].asDict()}")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; what they were comes back."""
    before = {k: spark.conf.getAll.get(k) for k in wanted}  # None where nobody set it
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Keyed state on executors' disks, with its changes in the checkpoint folder.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def start(
    stream: DataFrame, keys: list[str], evaluate: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, group: str, sums: dict[str, str],
    expected: int | None = None, every: int = 256, once: bool = True, seconds: int = 30,
) -> StreamingQuery:
    """Evaluates the rows of a stream micro-batch by micro-batch, each key once.

    Which keys were seen is the stream's own state, so a batch costs what it holds, however much came before; rows of a seen key
    are held back and counted (see finish). Each batch overwrites its own folders, so one that runs again leaves the same:
    ``results/batch=<n>/<group>=<value>`` its evaluated rows, and ``sums/batch=<n>`` a row for each group, its number of rows and the named
    sums. publish() adds those up. ``evaluate`` is deterministic and gives the column ``group``, which has few values; ``sums`` are named SQL aggregates that can be added up.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        rows = evaluate(batch).persist()
        try:
            rows.write.mode("overwrite").partitionBy(group).parquet(f"{store}/results/batch={number}")
            rows.groupBy(group).agg(F.count("*").alias("rows"), *(F.expr(c).alias(k) for k, c in sums.items())).coalesce(1).write.mode("overwrite").parquet(f"{store}/sums/batch={number}")
        finally:
            rows.unpersist()
        publish(batch.sparkSession, store, group, list(sums), expected, every)

    writer = stream.dropDuplicates(keys).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    with _settings(spark, STATE):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def finish(query: StreamingQuery, repeated_ok: bool = False) -> list[dict]:
    """Waits for the end; batch, rows read and rows of keys seen before (R5) of each batch with rows. Those raise unless they are allowed; the rows
    seen first stay as results either way."""
    query.awaitTermination()
    done = []
    for p in query.recentProgress:
        if p["numInputRows"]:
            repeated = sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for s in p["stateOperators"])
            done.append({"batch": p["batchId"], "rows": p["numInputRows"], "repeated": repeated})
    if not repeated_ok and any(x["repeated"] for x in done):
        raise ConstraintError(f"key seen twice: {[x for x in done if x['repeated']]}")
    return done


def found(df: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None where there is no such path."""
    try:
        return df()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def results(spark: SparkSession, store: str) -> DataFrame | None:
    """All results so far, with the batch they came in; None before the first."""
    return found(lambda: spark.read.parquet(f"{store}/results"))


def published(spark: SparkSession, store: str) -> DataFrame | None:
    """The sums that were published last, with their state and the last batch in them; None before the first."""
    both = found(lambda: spark.read.parquet(f"{store}/summary"))
    if both is None:
        return None
    last = both.agg(F.max_by("state", F.struct("through", F.col("state") == "final")).alias("_s"))
    return both.join(F.broadcast(last), F.col("state") == F.col("_s")).drop("_s")  # one row is broadcast


def publish(spark: SparkSession, store: str, group: str, sums: list[str], expected: int | None, every: int = 256) -> str | None:
    """A new summary once ``every`` more rows are evaluated, or all that are expected: ``summary/state=partial`` or ``state=final``.

    It is the last one's sums and those of the batches since; both have a row for each group. Gives the state it wrote, if any.
    """
    known = found(lambda: spark.read.parquet(f"{store}/sums"))
    if known is None:
        return None
    names = ["rows", *sums]
    last = published(spark, store)
    state, through, before = last.agg(F.first("state"), F.max("through"), F.sum("rows")).first() if last is not None else (None, -1, 0)
    new = known.where(F.col("batch") > through)
    both = new.select(group, *names, "batch") if last is None else new.select(group, *names, "batch").unionByName(last.select(group, *names, F.col("through").alias("batch")))
    total = both.groupBy(group).agg(*(F.sum(c).alias(c) for c in names), F.max("batch").cast("long").alias("through"))
    rows = total.collect()  # a row for each group
    done, newest = sum(r["rows"] for r in rows), max((r["through"] for r in rows), default=-1)
    complete = expected is not None and done >= expected
    if not rows or (newest <= through and not (complete and state != "final")) or (done - (before or 0) < every and not complete):
        return None
    table = spark.createDataFrame([(*r[:-1], newest) for r in rows], total.schema)
    state = state_of(done, expected) if expected is not None else "partial"
    table.coalesce(1).write.mode("overwrite").parquet(f"{store}/summary/state={state}")
    return state


def state_of(done: int, expected: int) -> str:
    """What a published snapshot is called."""
    return "final" if done >= expected else "partial"


def batches_until(keys: list, size: int, target: int, run: Callable[[list], int]) -> int:
    """Bounded batches, one after the other, until as many successes as wanted."""
    done = 0
    for i in range(0, len(keys), size):
        done += run(keys[i : i + size])
        if done >= target:
            break
    return done
