"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and Python regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, **own: Column) -> DataFrame:
    """Every row of docs as one struct, row, beside columns of our own: no column of docs clashes with these, whatever its name."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


def unboxed(boxes: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the rows in boxes, some of them changed."""
    return boxes.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{quoted(c)}") for c in columns])


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder that the session names in ``spark.checkpoint.dir``. Only a local session may leave that unset; a temporary
    folder of this machine is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{root}")
        root = f"file://{root}"
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet in a shared folder and read again: its lineage ends here, and a lost executor costs no earlier stage."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
