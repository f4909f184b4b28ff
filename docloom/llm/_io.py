"""Reading inputs and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python group holds at a time.
PART_BYTES = 16 << 20
#: Partitions of a shuffle, at most.
MOST_TASKS = 20_000
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session gets a temporary folder; on a cluster it must be set.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.setdefault(context.applicationId, "")
        if not root:
            root = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{root.rstrip('/')}/docloom/{context.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that have not been written elsewhere read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_parts(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Parts of about part_bytes each, and at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def n_tasks(parts: int) -> int:
    """Shuffle partitions for so many parts: a task works off several parts in turn where a driver could not track one for each."""
    return min(parts, MOST_TASKS)
