"""Session settings and the two helpers that need the live session."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task's tables in memory are some 40 times its compressed input, so inputs stay small at any size of the tables.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    # A hot entity in an event-to-spine join is split even where the join
    # output feeds a grouping on the same key (costs one extra exchange).
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # persisted tables get as many partitions as their size asks for
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # first k rows of a key are limited before the shuffle for any k, not only up to 1000
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the library's settings; ``master=None`` keeps the cluster's own."""
    b = SparkSession.builder.appName("chartline")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    temporary one is set only where the session runs in one local process.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="chartline-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables: inside the shared checkpoint folder the
    session names, or a new temporary folder in a one-process local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="chartline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A fitted table that the driver holds, as a table; joins know its size and broadcast it only where it is small."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(fields)), fields)
