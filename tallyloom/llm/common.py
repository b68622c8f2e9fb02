"""Helpers shared by the operators of this package.

Conventions that hold for all of them:

* only the columns an operator names are read, so extra columns never clash with its own;
* a null text is an empty text; a null id stays null in the result and, where ids are
  ordered or joined, counts as one id after all others;
* rows with the same id and the same text are one document given several times and get the same
  result each; rows with the same id and different texts are different documents.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"tallyloom-{uuid.uuid4().hex}")
        sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, merge: bool = False) -> DataFrame:
    """big joined to small (unique in the column on): rows of one value of big are dealt over salts tasks, small goes to each.

    Spark may broadcast the copies where they are below its threshold; with merge never.
    """
    salt = free_name(big, "_salt")
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied.hint("merge") if merge else copied, [on, salt]).drop(salt)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a table that fresh_path() named, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def key_of(column: str) -> Column:
    """An id as a long that orders and joins; null comes last."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(LAST_ID))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def bytes_of(column: str) -> Column:
    return F.encode(text_of(column), "UTF-8")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns what finished work has freed to the system: a Python worker stays for later tasks, and would hold its peak beside the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(batches, rows: int = 1_000, size: int = 4 << 20):
    """Slices of batches: no more than so many rows and, at the batch's mean length, bytes. What a task makes of a slice is all that it holds in Python, and
    after the last one it gives back its memory."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)
    batch = None
    give_back()


def text_at(df: DataFrame, columns: list[str], text_col: str) -> int | None:
    """Where the text stands among columns as a string that tasks can read; None where it must be sent besides."""
    return columns.index(text_col) if text_col in columns and dict(df.dtypes).get(text_col) == "string" else None


def batch_of(columns: dict[str, list], schema: T.StructType) -> pa.RecordBatch:
    """An Arrow batch from Python lists or arrays in the order and the types of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    arrays = [pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x if x.type == f.type else x.cast(f.type) for f, x in ((f, columns[f.name]) for f in arrow)]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


SIMPLE = {"long": T.LongType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def kind_of(name: str) -> T.DataType:
    """A type from its SQL name, without a session; what isn't known here is left to Spark."""
    if name in SIMPLE:
        return SIMPLE[name]
    if name.startswith("array<"):
        return T.ArrayType(kind_of(name[6:-1]))
    if name.startswith("struct<") and "<" not in name[7:]:
        return struct(*[tuple(f.split(":")) for f in name[7:-1].split(",")])
    return T._parse_datatype_string(name)


def struct(*fields) -> T.StructType:
    """A schema from pairs of name and type, or the type's SQL name."""
    return T.StructType([T.StructField(n, kind_of(t) if isinstance(t, str) else t) for n, t in fields])
