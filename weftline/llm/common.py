"""Pieces that the operators share: word splitting, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the space and the ASCII control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Runs of non-separator characters; an empty array for a text without any."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """The number of words, without building them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bucket_of(text: Column, modulus: int) -> Column:
    """crc32 of a text (null: empty), modulo; decides folds."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a local one where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Lets Spark remove a query's shuffle files once the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of `cut` in use, in the order in which they were written.
_cuts: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what `cut` wrote within it."""
    n = len(_cuts)
    try:
        yield
    finally:
        while len(_cuts) > n:
            remove(spark, _cuts.pop())


def write(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """The rows of `df`, read back from Parquet at `path`. The shuffles behind them are over and their files go."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage ends there and survives lost executors."""
    _cuts.append(f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    return write(df, _cuts[-1], compression)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*dfs: DataFrame) -> None:
    """Removes what `cut` wrote for each of `dfs`, which aren't to be read again."""
    for df in dfs:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if name.startswith(shared_dir(df.sparkSession)):
                remove(df.sparkSession, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
