"""Small helpers around the session: bounded local tables and reliable cuts of a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """Local relation for rows whose number is bounded by the schema or the plan, never by the data."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    dicts = [r if isinstance(r, dict) else dict(zip(names, r)) for r in rows]
    table = pa.Table.from_pylist([{k: d.get(k) for k in names} for d in dicts], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a scratch folder only where Spark runs on one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes reread the written rows and survive lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """The rows written as Parquet below the shared folder and read again: later passes read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """(the rows, written once, how many there are): the write itself counts them. Tables that Parquet cannot hold (names
    that differ in case only, columns without a type) are checkpointed and counted."""
    plain = len({c.lower() for c in df.columns}) == len(df.columns) and not any(
        isinstance(f.dataType, T.NullType) for f in df.schema.fields)
    if not plain:
        out = cut_lineage(df)
        return out, out.count()
    counted = Observation()
    out = staged(df.observe(counted, F.count(F.lit(1)).alias("n")))
    return out, counted.get.get("n") or 0


def together(*jobs: Callable) -> list:
    """Results of independent actions submitted at once, so that small stages share the executors."""
    session = SparkSession.getActiveSession()
    wrap = inheritable_thread_target(session) if session is not None else (lambda job: job)
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]
