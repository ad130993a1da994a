"""What the training-data operators share: the word pattern, table reads, lineage cuts and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, release, shared_folder

#: A word: a run of characters other than the six ASCII blanks. Java and Python read it alike.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The six blanks as characters, for trimming and counting.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark alone, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in the text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of texts that a Python worker is given at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> None:
    """Bounds the session's Arrow batches by bytes, so that long texts cannot fill a Python worker; a smaller bound stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(conf.get(key))
    except ValueError:  # with a unit
        now = BATCH_BYTES + 1
    if now < 1 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def number_copies(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name: 0, 1, ... among the rows that are equal in key, in no particular order; 0 for rows that have no equal.

    Where there are equal rows they are numbered by input partition first and partitions are put
    one after another, so that a key that a third of all rows have is in no single task.
    """
    again = df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    parts = cut(df).withColumn("copy_part", F.spark_partition_id())
    counts = parts.groupBy(key, "copy_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("copy_part")) - F.col("n")
    offsets = counts.select(F.col(key).alias("copy_key"), F.col("copy_part").alias("copy_at"), before.alias("copy_before"))
    numbered = parts.withColumn(name, F.row_number().over(Window.partitionBy(key, "copy_part").orderBy(key)).cast("long") - 1)
    both = numbered.join(offsets, F.col(key).eqNullSafe(F.col("copy_key")) & (F.col("copy_part") == F.col("copy_at")))
    return both.select(*df.columns, (F.col(name) + F.col("copy_before")).alias(name))


def has_columns(df: DataFrame, *names: str) -> None:
    """Raises ValueError where a column that the operator reads is missing."""
    if missing := [x for x in names if x not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
