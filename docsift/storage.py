"""Rows dealt once by a key, and tables that several branches of one query read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of texts, as Spark estimates them (about half of what is stored), in one part of spread(): the words of a part, some
#: 300 bytes each, are then sorted in a task's memory and not on its disk. And the most parts.
PART, MOST_PARTS = 1 << 19, 1 << 15


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys once, before texts are cut to words, into parts whose number follows the size of the input.

    Windows, groups and joins whose keys begin with these then stay where they are, so texts are shuffled and their
    words never. The number is given, as small parts of texts would be joined to few, whose words are not small. Without
    the setting, Spark deals both sides of a join anew unless they are dealt by all of its keys.
    """
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 50  # Spark's guess where it knows nothing is larger
    return rows.repartition(max(least, min(size // PART, MOST_PARTS)) if known else least, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='docsift-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/docsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing is read from any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)
