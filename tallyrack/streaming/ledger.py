"""Jobs and their rows as tables that micro-batches upsert, once each.

A batch writes its jobs and their rows into folders of its own number and only then its line in the ledger.  A batch
that is repeated after a loss writes the same folders anew; one that was cut short is not in the ledger and isn't seen.
What a reader sees of a job is its last version, and of its rows those that came with it: a new version deletes the rows
of the one before and puts its own in their place, though nothing is rewritten.  Compaction folds batches into one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class JobStore:
    """Tables under a folder that all executors share: jobs (job_id, version order `nth`, others) and rows (job_id, others)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _lines(self) -> DataFrame:
        """(batch, upto): a line for each batch that is whole; upto is that of the last batch a compaction has taken in."""
        try:
            return self.spark.read.parquet(f"{self.root}/ledger").select("batch", "upto")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], "batch long, upto long")

    def _seen(self, table: str) -> DataFrame:
        """A table's rows of whole batches, those before the last compaction left out.  The ledger has a line a batch and
        is joined by the batch, which is the tables' folder, so that other folders aren't read."""
        lines = self._lines()
        base = lines.filter("upto >= 0").agg(F.max("upto")).first()[0]
        whole = [r.batch for r in lines.filter(F.lit(base is None) | (F.col("upto") == F.lit(base)) | ((F.col("upto") < 0) & (F.col("batch") > F.lit(base)))).select("batch").collect()]
        held = self.spark.read.option("basePath", f"{self.root}/{table}")
        return held.parquet(*(f"{self.root}/{table}/batch={b}" for b in whole)).withColumn("batch", F.col("batch").cast("long"))

    def _last(self) -> DataFrame:
        """The last version of each job and the batch it came with; a compacted one counts as of the batch it took in."""
        held = self._seen("jobs")
        others = [c for c in held.columns if c != "job_id"]
        return held.groupBy("job_id").agg(F.max_by(F.struct(*others), F.struct(F.when(F.col("batch") < 0, -1).otherwise(F.col("batch")), "nth")).alias("v")).select("job_id", "v.*")

    def jobs(self) -> DataFrame:
        return self._last().drop("batch")

    def rows(self) -> DataFrame:
        """The rows that came with each job's last version."""
        return self._seen("rows").join(self._last().select("job_id", "batch"), ["job_id", "batch"], "left_semi").drop("batch")

    def upsert(self, jobs: DataFrame, rows: DataFrame, batch: int) -> None:
        """One micro-batch, whole or not at all; the same number again is the same batch.  Of a job's versions within the
        batch the last by nth counts."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        others = [c for c in jobs.columns if c != "job_id"]
        last = jobs.groupBy("job_id").agg(F.max_by(F.struct(*others), "nth").alias("v")).select("job_id", "v.*")
        last.write.mode("overwrite").parquet(f"{self.root}/jobs/batch={batch}")
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
        self._line(batch, -1)

    def compact(self) -> None:
        """Writes what is seen now as one batch (numbered -2 - the last that it takes in) that stands for all of them."""
        upto = self._lines().agg(F.max(F.greatest("batch", "upto"))).first()[0]
        if upto is not None:
            base = -2 - upto
            self.jobs().write.mode("overwrite").parquet(f"{self.root}/jobs/batch={base}")
            self.rows().write.mode("overwrite").parquet(f"{self.root}/rows/batch={base}")
            self._line(base, upto)

    def _line(self, batch: int, upto: int) -> None:
        line = self.spark.createDataFrame([(batch, upto)], "batch long, upto long").coalesce(1)
        line.write.mode("overwrite").parquet(f"{self.root}/ledger/line={batch}")


def upsert_stream(stream: DataFrame, store: JobStore, checkpoint: str):
    """A stream of (job_id, nth, status, url, rows array<struct>) into the store; micro-batches keep their numbers when
    they are repeated."""

    def handle(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("nth"))) == 1
        kept = held.withColumn("_last", last).filter("_last").drop("_last")
        store.upsert(kept.drop("rows"), kept.select("job_id", F.posexplode("rows").alias("row_index", "row")).select("job_id", "row_index", "row.*"), number)
        held.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
