"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may belong to any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary one; on a cluster, whose machines share no such folder, that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        chosen = context._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            configured = chosen.get()
        elif context.master.startswith("local"):
            configured = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage the way ``checkpoint()`` does, but columnar, compressed and prunable, and it
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialize`` returned, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/scriptorium/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def reclaim_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that the heap shrinks and the shuffles and broadcasts of finished rounds are dropped.

    Spark drops these only when the driver happens to collect; many small jobs let its heap grow to the limit first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reclaim_executors(spark: SparkSession) -> None:
    """Collect the executors' garbage: a heap that earlier stages filled shrinks, and leaves its memory to the Python workers beside it."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()
