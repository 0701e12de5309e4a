"""What the operators share: words, let-bindings in column expressions, staged tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z only.
LOWER_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A table of at most so many bytes, by a count of its rows, may be broadcast.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. Texts that are all ASCII take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """(row, more...): the caller's columns as one struct, so that no name of theirs meets one of an operator's own."""
    return df.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in more.items()))


def whole_row(df: DataFrame) -> Column:
    """packed()'s row as something that can be hashed: maps have no hash of their own."""
    return F.to_json("row") if "map<" in df.schema.simpleString() else F.col("row")


def place_of(df: DataFrame, column: str) -> int:
    """Where a column stands in the struct of packed()."""
    return [c.lower() for c in df.columns].index(column.lower())


def unpacked(df: DataFrame, *made: str) -> DataFrame:
    """The caller's columns, but for those that share a name with `made` in whatever case, and then `made`."""
    names = {m.lower() for m in made}
    kept = [n for n in df.schema["row"].dataType.names if n.lower() not in names]
    return df.select(*(F.col("row").getField(n).alias(n) for n in kept), *made)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset on one machine (tests), a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/barloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_bytes(df: DataFrame, more: Column | None = None) -> int:
    """The size of df by a count: a row is 24 bytes, 8 for each column and `more` (for arrays and strings)."""
    row = 24 + 8 * len(df.columns)
    return df.agg(F.count("*") * row + F.coalesce(F.sum(more), F.lit(0)) if more is not None else F.count("*") * row).first()[0]


def small(df: DataFrame, more: Column | None = None, bytes_: int | None = None) -> DataFrame:
    """df marked for broadcast if counted_bytes() shows that it is within the bound; else as it is, for a shuffled join. Pass a staged df."""
    return F.broadcast(df) if counted_bytes(df, more) <= (BROADCAST_BYTES if bytes_ is None else bytes_) else df
