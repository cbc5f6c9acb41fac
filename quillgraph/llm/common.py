"""What the operators share: the cluster's scratch folder and stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, from ``spark.checkpoint.dir``; where that is unset, one of our own if all runs on this machine (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more: what was made of them must be stored itself."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(text) -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


#: Values that one row of a summed vector holds.
WIDTH = 64


def vector_rows(vector) -> "pa.RecordBatch":  # noqa: F821
    """A task's share of a vector of fixed size, as rows for ``vector_sum``."""
    import numpy as np
    import pyarrow as pa

    flat = np.asarray(vector, np.float64).ravel()
    flat = np.pad(flat, (0, -len(flat) % WIDTH))
    blocks = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), blocks], ["block", "v"])


VECTOR_SCHEMA = "block int, v array<double>"


def vector_sum(parts: DataFrame, size: int):
    """The sum of all tasks' vectors of ``size`` values: Spark adds them block by block, the driver gets one vector."""
    import numpy as np

    sums = parts.groupBy("block").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(WIDTH)])
    out = np.zeros(size + (-size % WIDTH))
    for row in sums.collect():
        out[row[0] * WIDTH : (row[0] + 1) * WIDTH] = row[1:]
    return out[:size]
