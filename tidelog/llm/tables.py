"""Reading the tables and settling the columns that an operator takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[str]:
    """Column names as Spark takes them whatever is in them, a dot say."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing may be learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, most: int, *columns: str) -> DataFrame:
    """Rows of `docs` with `columns` for at most `most` ids, by a hash of the id; of an id's rows the one whose text has the least hash. Rows without an id have no part."""
    known = docs.where(F.col("doc_id").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = known.select("doc_id", F.struct(*columns).alias("_row"), F.xxhash64(*columns).alias("_hash")).join(F.broadcast(ids), "doc_id", "left_semi")  # `most` ids
    return rows.groupBy("doc_id").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")


def settle(frame: DataFrame) -> DataFrame:
    """Cut the lineage in storage that all executors share.

    With spark.checkpoint.dir set this is a reliable checkpoint. Where it is unset (tests),
    a folder below the warehouse is set first.
    """
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            where = frame.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(where)
    return frame.checkpoint()
