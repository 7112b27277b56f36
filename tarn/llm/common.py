"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whatever is not one of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset and all is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tarn/{label}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_drop_staged)
    _staged.append((spark, path))
    return path


def stage_table(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder, once, and read it back.

    Survives the loss of any executor, as the files are in shared storage. They are removed when the driver ends. A loop
    passes two of `staged_path` in turn, so that no more than two rounds are held."""
    path = path or staged_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row; a plain expression inside a lambda is computed per element."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(sizes: Column, block: int = 64, levels: int = 3) -> Column:
    """The sums of an array of ints before each place, in blocks of blocks, so that no long array is copied at each step."""
    zero = F.lit(0)

    def direct(a: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), F.lit(1), F.size(a))

    def blocked(a: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor((F.size(a) - 1) / block).cast("int")), lambda k: F.slice(a, k * block + 1, F.lit(block)))

        def joined(b: Column) -> Column:
            before = prefix_sums(F.transform(b, lambda x: F.aggregate(x, zero, lambda acc, n: acc + n)), block, levels - 1)
            return let(before, lambda s: F.flatten(F.transform(b, lambda x, k: F.transform(direct(x), lambda v: v + F.element_at(s, k + 1)))))

        return let(blocks, joined)

    if levels <= 1:
        return let(sizes, direct)
    return let(sizes, lambda a: F.when(F.size(a) <= block, direct(a)).otherwise(blocked(a)))
