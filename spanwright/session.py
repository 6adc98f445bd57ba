"""Session set-up, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20


def build_session(app: str = "spanwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and skew handling on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give text-heavy work enough tasks when a table has few splits.

    A large table has far more splits than the cluster has slots and is left as it is. The
    hash layout by document also serves the later joins and windows on that key.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * slots else df.repartition(2 * slots, key)


TASK_ROWS = 400_000


def bounded_tasks(df: DataFrame, key: str) -> DataFrame:
    """Lay a large table out by `key` with at most about `TASK_ROWS` rows per task.

    Adaptive planning joins shuffle partitions by their bytes. Narrow rows that grow wide later in the same task, as
    order lines do, then give tasks whose sorts hold gigabytes.
    """
    tasks, slots = -(-df.count() // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism
    # a few tasks more than slots would leave most slots idle in a second round
    return df.repartition(max(tasks, 4 * slots), key) if tasks > slots else df


def computed_once(df: DataFrame, key: str, rows: int) -> DataFrame:
    """`df`, about `rows` rows that are costly to make, laid out by `key`: a plan that reads it several times shares this shuffle.

    With as many tasks as other shuffles have, joins and groups on the key find their rows in place.
    """
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder for local sessions without `spark.checkpoint.dir`; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="spanwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in `spark.checkpoint.dir`.

    A cluster without that setting is refused: a machine-local folder would not survive the loss
    of that machine. Only a local session gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so that lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder. For loops that join their own results.

    A checkpoint keeps the planner's constraints and size estimates, and those of joins multiply: after a dozen rounds
    planning alone takes minutes. A table that is read again starts from its file sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    parts = [F.lit(16)]
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            parts.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + F.lit(8))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Size of a table from one distributed aggregate (not an optimizer estimate)."""
    return df.agg(F.sum(_row_bytes(df))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the measured size is under `limit`; else a normal shuffle join."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df
