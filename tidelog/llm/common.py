"""Shared helpers of the training-data operators: reading tables, shared scratch space, ASCII folding."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of groups up to which it is broadcast (some hundred bytes each, so a few MB); salts that spread a hot key beyond that.
BROADCAST_ROWS, SALTS = 10_000, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package; on a cluster it is installed, or given as --py-files."""
    if spark.sparkContext.master.startswith("local["):
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one is made only when a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Intermediate tables in the shared folder. Writing one cuts lineage; a lost executor loses nothing of it."""

    def __init__(self, spark: SparkSession):
        on_workers(spark)
        self.spark, self.base = spark, f"{scratch_root(spark)}/tidelog-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, through Spark's own file system layer."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same on all-ASCII text, and far faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n_groups: int, *, spread: str = "doc_id", how: str = "inner") -> DataFrame:
    """Joins rows with groups, a table of n_groups rows at most with one row per key, however many of the rows have the same key.

    Up to BROADCAST_ROWS groups are broadcast. More are repeated under salts, and the column `spread` chooses a row's salt, the same
    one whenever a lost task runs again.
    """
    if n_groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on, how)
    salted = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

