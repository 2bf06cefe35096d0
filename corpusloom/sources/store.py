"""Stored tables: query logs in monthly partitions, and the chunk store with its upserts and deletes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.storage import checkpoint, remove
from corpusloom.operators.telemetry import at

#: Outdated (key, batch) pairs that are broadcast; more are joined by a shuffle.
BROADCAST = 500_000


def month_of(ts: Column) -> Column:
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM")


def write_query_logs(rows: DataFrame, path: str) -> None:
    """Appends log rows to monthly partitions; a month is one shuffle key, split by AQE where it is large."""
    rows.withColumn("month", month_of(F.col("ts"))).hint("rebalance", "month").write.partitionBy("month").mode("append").parquet(path)


def migrate_query_logs(old: DataFrame, path: str) -> None:
    """Copies rows of an old layout; a missing timestamp becomes created_at."""
    write_query_logs(old.withColumn("ts", F.coalesce("ts", "created_at")).drop("created_at"), path)


def list_partitions(logs: DataFrame) -> DataFrame:
    """Rows and bounds of each month."""
    return logs.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def partition_health(logs: DataFrame, as_of: str) -> DataFrame:
    """Issues: the current or next month has no partition, a month between first and last has none, or a row's time lies
    outside its month."""
    months = logs.select("month").distinct()
    now = F.date_trunc("month", at(as_of))
    bounds = logs.agg(F.date_trunc("month", F.min("ts")).alias("a"))
    expected = bounds.select(
        F.explode(F.sequence(F.least(F.coalesce("a", now), now), now + F.expr("INTERVAL 1 MONTH"), F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(
        F.date_format("m", "yyyy-MM").alias("month"),
        F.when(F.col("m") == now, "missing current").when(F.col("m") > now, "missing next").otherwise("gap").alias("issue"),
    )
    missing = expected.join(months, "month", "left_anti").withColumn("n", F.lit(0).cast("long"))
    outside = logs.filter(~F.col("month").eqNullSafe(month_of(F.col("ts")))).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return missing.unionByName(outside.select("month", F.lit("outside range").alias("issue"), "n"))


def drop_partitions(logs: DataFrame, as_of: str, retention_months: int = 12) -> DataFrame:
    """Rows of the months that are kept: calendar months, the cutoff month included. The filter is on the partition column."""
    cutoff = F.date_format(F.add_months(F.date_trunc("month", at(as_of)), -retention_months), "yyyy-MM")
    return logs.filter(F.col("month") >= cutoff)


def _below(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The folders under path that match a pattern, relative to it; a listing of names, on any file system of Spark's."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")) or []
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    return sorted(f.getPath().toUri().getPath()[len(base) + 1 :] for f in found if f.isDirectory())


def _remove(spark: SparkSession, path: str, folders: Iterable[str]) -> None:
    for folder in folders:
        remove(spark, f"{path.rstrip('/')}/{folder}")


def remove_months(spark: SparkSession, path: str, as_of: str, retention_months: int = 12) -> list[str]:
    """Removes the partitions of the stored logs that lie before the cutoff month and returns their months, in order.

    The months come from the names of the folders: no row and no file of a kept month is read or written. Rows without a
    timestamp (the default partition) stay. Removing twice removes nothing more; a path without a table has no month."""
    cutoff = spark.range(1).select(F.date_format(F.add_months(F.date_trunc("month", at(as_of)), -retention_months), "yyyy-MM")).first()[0]
    months = [f.removeprefix("month=") for f in _below(spark, path, "month=*")]
    gone = [m for m in months if len(m) == len(cutoff) and m[:4].isdigit() and m < cutoff]
    _remove(spark, path, [f"month={m}" for m in gone])
    return gone


def delete_old_logs(logs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows no older than so many days; months that lie wholly before are not read."""
    cutoff = at(as_of) - F.make_interval(days=F.lit(days))
    return logs.filter((F.col("month") >= month_of(cutoff)) & (F.col("ts") >= cutoff))


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store after the incoming rows: an equal id replaces, a new one inserts; a rerun changes nothing."""
    fresh = incoming.dropDuplicates([key])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_chunks(store: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store without rows that match the keys' columns, one row with the number deleted)."""
    on, gone = keys.columns, keys.distinct()
    return store.join(gone, on, "left_anti"), store.join(gone, on, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def store_stats(store: DataFrame) -> DataFrame:
    """Points and distinct sources of each source_type, and a total in the row with a null type."""
    return store.rollup("source_type").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("source").alias("sources")).filter(
        (F.grouping_id() == 1) | F.col("source_type").isNotNull()
    )


def count_by(store: DataFrame, *keys: str) -> DataFrame:
    return store.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def source_types(store: DataFrame) -> DataFrame:
    return store.select("source_type").distinct().orderBy("source_type")


class Snapshots:
    """A table as numbered snapshot folders with a pointer to the current one. A reader sees the old or the new table;
    the pointer is one row, written after its snapshot is complete. Pointers are numbered by one writer; those without
    a number come before all others, in the order of their times."""

    POINTER = "name string, ts timestamp, no long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, table: DataFrame, as_of: str) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        no = self._next()
        self.spark.range(1).select(F.lit(name).alias("name"), at(as_of).alias("ts"), F.lit(no).cast("long").alias("no")).write.mode("append").parquet(f"{self.path}/_pointers/log")
        return name

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema(self.POINTER).parquet(f"{self.path}/_pointers/log")

    def _next(self) -> int:
        """One more than the greatest number so far; 0 where there is no pointer."""
        try:
            last = self._pointers().agg(F.max("no").alias("no")).first()["no"]
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return 0 if last is None else last + 1

    def current(self) -> DataFrame:
        newest = self._pointers().orderBy(F.col("no").desc_nulls_last(), F.col("ts").desc(), F.col("name").desc()).first()
        return self.spark.read.parquet(f"{self.path}/{newest['name']}")


class Batches:
    """A keyed table that takes batches of new, changed and removed keys and writes only these.

    Rows lie in partitions `bucket=B/batch=K`: a bucket is a hash of the key, and a batch replaces its own partitions and no
    others (dynamic partition overwrite), so that a batch that runs again changes nothing and the work of a batch grows
    with the batch. Of each key only the rows of its latest batch count; a key that a batch removes gets one row
    that says so. A key may have any number of rows; rows with a null key are
    never replaced. Numbers are given by one writer, greater with each batch (a stream's
    batch numbers, for instance). Rows of a batch may be seen before all its partitions are in place; a reader that must
    not see them names the batch it reads before."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        """All rows of all batches, with _live, bucket and batch."""
        schema = f"{self.schema}, _live boolean, bucket int, batch long"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch").parquet(self.path)
        )

    def write(self, batch: int, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Rows replace those of their keys. keys: all that the batch decides on; those without a row are removed."""
        fresh = rows.select(*self.columns).withColumn("_live", F.lit(True))
        if keys is not None:
            gone = keys.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti").withColumn("_live", F.lit(False))
            fresh = fresh.unionByName(gone, allowMissingColumns=True)
        self._put(fresh.withColumn("bucket", self._bucket()).withColumn("batch", F.lit(batch).cast("long")))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The rows of each key's latest batch, removals included. Outdated pairs of key and batch are few beside the rows;
        where they are, the rows aren't shuffled."""
        versions = rows.select(self.key, "batch").distinct()
        last = versions.groupBy(self.key).agg(F.max("batch").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        outdated = checkpoint(versions.join(last, self.key).filter("batch < _last").select(self.key, "batch"))
        n = outdated.count()
        if not n:
            return rows
        return rows.join(F.broadcast(outdated) if n <= BROADCAST else outdated, [self.key, "batch"], "left_anti")

    def current(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table, or as it was before a batch. With keys, their rows: only the buckets that hold them are read."""
        rows = self._rows()
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        if keys is not None:
            wanted = keys.select(self.key).distinct()
            touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most the number of buckets
            rows = rows.filter(F.col("bucket").isin(touched) if touched else F.lit(False)).join(wanted, self.key, "left_semi")
        return self._latest(rows).filter("_live").select(*self.columns)

    def compact(self, least: int = 8) -> int:
        """Brings the buckets with so many batches down to one each and returns how many these were. The merged rows go
        into a bucket's latest batch first, then the earlier ones go, so that a stop in between leaves the table as it
        was. Not while others read the table: they may miss files."""
        held: dict[int, list[int]] = {}
        for folder in _below(self.spark, self.path, "bucket=*/batch=*"):
            bucket, batch = (int(part.split("=")[1]) for part in folder.split("/"))
            held.setdefault(bucket, []).append(batch)
        full = {b: sorted(k) for b, k in held.items() if len(k) >= max(2, least)}
        if full:
            newest = F.create_map(*[F.lit(x) for b, k in full.items() for x in (b, k[-1])])
            rows = self._latest(self._rows().filter(F.col("bucket").isin(list(full))))
            self._put(rows.withColumn("batch", newest[F.col("bucket")].cast("long")))
            _remove(self.spark, self.path, [f"bucket={b}/batch={k}" for b, batches in full.items() for k in batches[:-1]])
        return len(full)


CHUNKS = "chunk_id string, source string, source_type string, content_type string, heading_path string, text string"
REGISTRY = "file_path string, content_hash string, source_type string, file_size long, chunk_count long, ingested_at timestamp, updated_at timestamp"


def chunk_store(spark: SparkSession, path: str, buckets: int = 64) -> Batches:
    """Chunks, replaced and removed by source."""
    return Batches(spark, path, CHUNKS, "source", buckets)


def file_registry(spark: SparkSession, path: str, buckets: int = 64) -> Batches:
    return Batches(spark, path, REGISTRY, "file_path", buckets)


def delete_from(table: Batches, batch: int, keys: DataFrame) -> int:
    """Removes the keys' rows, by a batch that writes one row for each key that the table has; the number of rows removed."""
    found = checkpoint(table.current(batch, keys).select(table.key))
    table.write(batch, table.current(batch).limit(0), found)
    return found.count()
