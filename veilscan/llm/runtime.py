"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir", "release", "restored", "shielded", "table", "written"]


def shielded(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct ``_row``, so that no name of theirs meets a name of an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_row"))


def restored(rows: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns that ``shielded`` put away, in their order, then the added ones, which take the place of columns named like them."""
    kept = [F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in columns if c not in added]
    return rows.select(*kept, *added)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: lineage ends here, and readers take only the columns they use."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets the cleaner drop shuffle files of plans that cut() has ended, instead of keeping them to the end of the job.

    Also gives the driver's free native memory back to the system: Spark runs each exchange on threads of its own, and
    the allocator keeps what they have freed in an arena for each, hundreds of MB after a few long plans.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _trim_jvm(spark: SparkSession) -> None:
    """What jcmd does as System.trim_native_heap; a JVM without that command keeps its memory."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, values):  # noqa: ANN001, ANN202
        out = array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        of = jvm.java.lang.Class.forName
        kinds = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        # by the interface's method: the server's own class is not open to reflection
        invoke = of("javax.management.MBeanServer").getMethod("invoke", filled(jvm.java.lang.Class, kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), filled(jvm.Object, [name, "systemTrimNativeHeap", None, None]))
    except Py4JError:
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
