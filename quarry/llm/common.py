"""Shared helpers: tables, lineage cuts in the cluster's shared folder, Arrow string buffers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves a session whose executors are in the driver's own JVM; on a cluster that
    would lose data, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _OWN_DIRS[0], ignore_errors=True)
    return _OWN_DIRS[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is then left to its owner
        pass


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost only their own tasks.

    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unused(names: list[str], name: str) -> str:
    """A column name like the given one that isn't among names, in any case of letters."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def place(names: list[str], name: str) -> int:
    """Where a column is, in any case of letters."""
    return [n.lower() for n in names].index(name.lower())


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that none clashes with a name that an operator makes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def given_back(df: DataFrame, names: list[str], made: list[str]) -> DataFrame:
    """The columns of plain() under their names, then those made; a given column named like one made gives way."""
    own = {n.lower() for n in made}
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in own], *made)


def id_text(col: str = "doc_id") -> Column:
    """The id as text; a null id counts as empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(id_text(col)) % folds == 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def windows(size: int, step: int) -> Iterator[tuple[int, int]]:
    for a in range(0, size, step):
        yield a, min(size, a + step)


def pieces(offsets: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
    """First row that reaches into bytes a..b, and the rows' starts within them (never twice the same)."""
    first = int(np.searchsorted(offsets, a, "right")) - 1
    inner = np.unique(offsets[(offsets > a) & (offsets < b)])
    return first, np.concatenate(([0], inner - a)).astype(np.int64)


def rows_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The (non-empty) row that holds each byte position."""
    return np.searchsorted(offsets, starts, "right") - 1


def arrow_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows of the batches that Python gets, so that whole texts fit beside the executor's heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df
