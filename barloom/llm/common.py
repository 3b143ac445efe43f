"""What the operators share: names that clash with nothing, folders that all executors see, sizes of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have; names are compared without case, as Spark does."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, into: str, text: str) -> tuple[DataFrame, list[str], str]:
    """The frame without a column `into` and with its columns numbered, which Arrow functions need for names with dots;
    the names that its result gets again, `into` last; and the new name of the text column."""
    names = [c for c in df.columns if c != into or c == text]
    keep = [k for k, c in enumerate(df.columns) if c in names]
    out = df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select(*(f"c{k}" for k in keep))
    return out, [*(df.columns[k] for k in keep), into], f"c{df.columns.index(text)}"


def renamed(df: DataFrame, **to: str) -> DataFrame:
    """Only the given columns, under the given names (new=old); the old ones are quoted, so that dots do no harm."""
    return df.select(*(F.col("`" + old.replace("`", "``") + "`").alias(new) for new, old in to.items()))


def row_hash(df: DataFrame) -> Column:
    """A hash of the row, to deal rows out evenly: copies of a text with other ids go to other places."""
    return F.xxhash64(*(F.col(f"`{c.replace('`', '``')}`") for c, kind in df.dtypes if not ("map<" in kind or "variant" in kind)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, as in tests, a
    folder of our own, which only a session in one process can share; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, so that a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def own_folder(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: from it the numbers of chunks and buckets follow, so that each stays small at any size."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """The frame's schema and nullable columns behind it, given as name=type."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more.items())])
