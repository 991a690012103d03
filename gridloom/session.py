"""Session helpers: tables, and the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and Spark runs on one machine a folder under the
    warehouse directory is taken; on a cluster that might be a local folder, so an unset setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process's Scratches have written; to be called once no result that reads them is needed any more."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


class Scratch:
    """Written tables that cut a long lineage; they live in the shared folder, so the loss of an executor costs nothing.

    Results read them lazily, so they stay until ``drop`` or ``clear``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        _ROOTS.add(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_and_sum(self, df: DataFrame, *sums: Column) -> tuple[DataFrame, list]:
        """write(), with aggregates of what is written, computed in the same job."""
        seen = Observation()
        out = self.write(df.observe(seen, *[c.alias(f"s{i}") for i, c in enumerate(sums)]))
        return out, [seen.get[f"s{i}"] for i in range(len(sums))]

    def drop(self, df: DataFrame | None) -> None:
        """Deletes what write() returned, once nothing reads it any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
