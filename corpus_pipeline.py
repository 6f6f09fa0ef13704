"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Stage 1 to 4 return the columns of documents; the last returns the pieces of packed sequences.

Every stage takes rows with null or repeated ids, null, empty and very long texts, and further columns of any name,
which it drops. Repeated rows are rows of their own until near_duplicates, which keeps one of them. A null text counts
as one without words: it is graded by the model's thresholds alone, has no lines, duplicates and passages, and is empty
from the stage repeats on. Empty tables pass through every stage; without labels every document is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, only_result
from gleaner.llm.jaccard_join import link_documents
from gleaner.llm.line_dedup import drop_boilerplate
from gleaner.llm.ordinal_quality import fit_on, grade_documents, label_grades
from gleaner.llm.packing import pack
from gleaner.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (good and not toxic) is at least one half stay, unchanged."""
    model = fit_on(docs, label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), levels=3)
    return grade_documents(docs, model, carry=("text", "lang", "source", "n_chars")).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over a tenth of their source's documents hold go from all of these."""
    return _documents(drop_boilerplate(docs, carry=("lang", "source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the document with the smallest id stays."""
    return link_documents(docs, width=5, percent=80, carry=("text", "lang", "source", "n_chars")).where("keeps").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that an earlier document (by id) or place holds go; the first copy stays."""
    return _documents(remove_repeats(docs, window=200, keep="first", carry=("lang", "source")).withColumnRenamed("kept", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of 1024 tokens: one row per piece."""
    import public_tokenizers as files

    return pack(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, length=1024, end_id=0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: The stages are not expressible in SQL as a whole (a fitted model, tokenizer ids); tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with only_result(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
