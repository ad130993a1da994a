"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
documents. run() writes every stage's rows and reads them again for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_folder, table
from lodestone.llm.linededup import dedup_lines, drop_emptied
from lodestone.llm.mixing import mix_sources, take_documents
from lodestone.llm.packing import pack_documents
from lodestone.llm.probminhash import drop_near_copies
from lodestone.llm.quality import clean_documents

#: Words of a block of the mix at least, so that documents are taken whole.
MIX_BLOCK = 1024


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text has changed, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their bad lines."""
    return _counted(clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; documents that nothing is left of go."""
    return _counted(drop_emptied(dedup_lines(docs, min_words=50)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them."""
    return take_documents(mix_sources(docs, min_block=MIX_BLOCK))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", pack),
]

#: Seeded block selection and best fit have no SQL form; tests/llm holds a brute-force version against run().
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; a stage's rows are deleted once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs
