"""A training corpus from `documents`, in stages; each is written as Parquet and read again by the next.

The quality classifier rejects; of near-duplicates one stays; personal data is sanitised; sources are
mixed to target weights (the rows are written in the order of the mix); texts become token ids.
Stages keep the columns of `documents`, but for the last, which returns doc_id, source, lang,
n_tokens, ids, and mix_file and mix_row: the place in the mix that the file and row read had.

Every stage takes nulls, empty and very long texts, repeated rows, ties and empty tables as its operator
says, and carries further columns of any name. The folders between the stages go when the application
ends. Stages set spark.sql.execution.arrow.maxRecordsPerBatch for the session to BATCH.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, mixing, neardup, pii, quality, vocab
from tidelog.llm.tables import quoted, table

#: Documents that score below this go.
LEAST_QUALITY = 0.5
#: Rows of a batch that Python's workers get: whole texts of ten times as many would fill much of a small executor.
BATCH = 1000
#: Pieces that a worker remembers in the last stage: it has had the other stages before, and their memory.
PIECES = 1 << 17


def _batches(spark: SparkSession) -> None:
    """Set for the session: the stages' plans run after their functions have returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject.

    A null or empty text is scored like any other; repeated rows stay or go together; without labels all stay.
    """
    _batches(spark)
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.good(spark, docs, forest, LEAST_QUALITY)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the least id, null last.

    Texts without words all stay; of rows with one id and text one stays.
    """
    _batches(spark)
    return neardup.deduplicated(docs, 5, 80)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with class names in place of personal data.

    Null texts stay null; all rows stay; texts without personal data stay as they are, but for terms that give a frequent value away.
    """
    _batches(spark)
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix of the sources, at weights by the square root of their sizes.

    A null source is one of its own; rows with one id stand next to each other in any order.
    """
    # The rows travel whole in one column, so that those of the mix clash with none.
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), "source", "doc_id")
    found = mixing.mix(rows, mixing.tempered(docs))
    return found.repartitionByRange("mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its place in the mix.

    A null or empty text has no ids; rows that were not read from files have null places.
    """
    _batches(spark)
    try:
        rows = docs.withColumns({"mix_file": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"), "mix_row": F.col("_metadata.row_index")})
    except AnalysisException:  # not read from files
        rows = docs.withColumns({"mix_file": F.lit(None).cast("int"), "mix_row": F.lit(None).cast("long")})
    got = bpe.encode(rows.select("doc_id", "source", "lang", "text", "mix_file", "mix_row"), vocab.public(bpe.VOCABULARY), most=PIECES)
    return got.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "mix_file", "mix_row")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("pii", without_pii),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The stages that SQL can't express (a fitted classifier, a tokenizer) are tested otherwise.
ORACLE_SQL = None


def _removed(spark: SparkSession, base: str) -> None:
    """The folder of a run goes, if the application still runs."""
    context = spark.sparkContext
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone
        if context._jsc is not None and not context._jsc.sc().isStopped():
            path = context._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; results between stages are in the folder that executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    base = f"{where.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, base)  # the result is read from it until then
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
