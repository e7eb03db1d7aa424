"""The job table in files: inserts append, deletes write only the days anew that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, job_type string, status string, created_us long, started_us long, completed_us long, day date"
FINAL = ("completed", "failed", "timeout")
DAY_US = 86_400_000_000


class JobTable:
    """Jobs by day of creation, a folder of Parquet files for each day.

    A change reads the rows of the days that hold what it removes, and overwrites these days by Spark's
    dynamic partition overwrite: files of other days stay as they are, and a job that fails before its
    end leaves all as it was. Days without rows left are removed after that. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """All jobs; an empty table has none."""
        if not self._path(self.folder)[0].exists(self._path(self.folder)[1]):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def insert(self, jobs: DataFrame) -> None:
        """Jobs(id, job_type, status, created_us, started_us, completed_us) are added; a null id becomes one above all there are.

        Ids given so rise but leave gaps.
        """
        top = self.rows().agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
        given = jobs.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
        new = F.coalesce("id", F.monotonically_increasing_id() + (max(top, given) + 1))
        day = F.timestamp_micros("created_us").cast("date")
        out = jobs.withColumn("id", new).withColumn("day", day).select("id", "job_type", "status", "created_us", "started_us", "completed_us", "day")
        out.write.partitionBy("day").mode("append").parquet(self.folder)

    def delete_pending(self, ids: DataFrame) -> None:
        """Of the jobs of ids(id) those that still wait go. (P5)"""
        gone = self.rows().where("status = 'pending'").join(ids.select("id").distinct(), "id", "left_semi")
        self._remove(gone.select("id", "day"))

    def retain(self, now_us: int, days: int = 7) -> None:
        """Jobs that ended over so many days before now_us go."""
        self._remove(self.rows().where(F.col("status").isin(*FINAL) & (F.col("completed_us") < now_us - days * DAY_US)).select("id", "day"))

    def truncate(self) -> None:
        """All jobs go."""
        system, path = self._path(self.folder)
        system.delete(path, True)

    def _remove(self, gone: DataFrame) -> None:
        """Rows gone(id, day) go: their days, of which there are few thousands at most, are read and written anew."""
        days = [r.day for r in gone.select("day").distinct().collect()]
        if not days:
            return
        touched: Column = F.col("day").isin([d for d in days if d is not None])
        if None in days:
            touched = touched | F.col("day").isNull()
        left = self.rows().where(touched).join(gone.select("id"), "id", "left_anti")
        # the files are read while their days are written beside them, and replaced when all is written
        counted = {r.day: r.n for r in left.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counted:
            left.select(*self.rows().columns).write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)
        for day in days:
            if day not in counted:
                system, path = self._path(f"{self.folder}/day={day if day is not None else '__HIVE_DEFAULT_PARTITION__'}")
                system.delete(path, True)

    def _path(self, path: str):
        """The Hadoop file system of a path, which reaches wherever Spark's readers do, and the path."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), found
