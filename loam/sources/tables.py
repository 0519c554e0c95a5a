"""Reading and writing the library's tables, folders of source files, JSON columns, and atomic replacement."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: File extensions that a scan keeps.
EXTENSIONS = ("pdf", "docx", "xlsx", "pptx", "txt", "md", "csv", "html", "png", "jpg", "jpeg")
MAX_BYTES = 50 * 1024 * 1024


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table of the driver's layout."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read from a few small files, dealt over all cores, so that Python work isn't left to one task.

    A table with as many splits as there are cores stays as it is: nothing is shuffled where the input is large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one of this machine's own, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "loam-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there: what is used several times is computed once, and a lost
    executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, in Parquet: long texts, repeated ones above all, take a fraction of a checkpoint, and later readers read the
    columns they need."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read in ``parts`` ranges of a numeric key, each its own task."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def write_by_tenant(df: DataFrame, path: str, tenant: str = "company_domain") -> None:
    df.write.mode("overwrite").partitionBy(tenant).parquet(path)


def scan_folder(spark: SparkSession, path: str, known: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, extension, length, modified, source_hash, content) of supported files under ``path``, largest left out.

    ``known`` (source_hash): files whose bytes are known already are left out. Of files with equal bytes the first by
    path stays.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kept = files.where(extension.isin(*EXTENSIONS) & (F.col("length") <= max_bytes) & (F.col("length") > 0))
    rows = kept.select("path", extension.alias("extension"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("source_hash"), "content")
    firsts = rows.groupBy("source_hash").agg(F.min("path").alias("path"))
    rows = rows.join(firsts, ["source_hash", "path"], "left_semi")
    return rows.join(known, "source_hash", "left_anti") if known is not None else rows


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page_number, text) of text files: a form feed starts a page."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("doc"), "value")
    pages = whole.select("doc", F.posexplode(F.split("value", "\f")).alias("at", "text"))
    return pages.select("doc", (F.col("at") + 1).alias("page_number"), "text")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(doc, row, cells) of CSV files as string arrays, for the table operators; no types are guessed."""
    lines = spark.read.option("recursiveFileLookup", "true").option("header", "false").csv(path)
    cells = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in lines.columns))
    return lines.select(F.input_file_name().alias("doc"), F.monotonically_increasing_id().alias("row"), cells.alias("cells"))


def json_pages(column: Column) -> Column:
    """array<struct<page_number,text>> of a JSON column; bad JSON is null."""
    return F.from_json(column, "array<struct<page_number:int,text:string>>")


def json_ids(column: Column) -> Column:
    """array<string> of a JSON column; bad JSON is null."""
    return F.from_json(column, "array<string>")


def json_array_size(column: Column) -> Column:
    """Elements of a JSON array; 0 for null, bad JSON or anything that is no array."""
    return F.coalesce(F.json_array_length(column), F.lit(0))


def bucket_of(key: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def replace_documents(spark: SparkSession, path: str, new: DataFrame, key: str = "article_id", buckets: int = 256, changed: DataFrame | None = None, order: tuple[str, ...] = ()) -> int:
    """Replaces all rows of the documents in ``new`` in a table partitioned by hash bucket; returns buckets rewritten.

    ``changed`` (key) names the documents to replace, where some of them have no new rows and go; without a table at ``path``
    it is made. Only buckets with changed documents are read and written, through a staged folder, and put in place by
    one dynamic partition overwrite. If building the new rows fails, nothing has been touched. In a file a document's rows lie
    side by side, by ``order``, so that what they repeat takes little room.
    """
    by = ("bucket", key, *order)
    staged, merged = (f"{path}.{name}-{uuid.uuid4().hex}" for name in ("staged", "merged"))  # two replacements may run at once
    new.withColumn("bucket", bucket_of(F.col(key), buckets)).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(staged)
    fresh = spark.read.schema(_with_bucket(new)).parquet(staged)
    gone = (fresh if changed is None else changed).select(key).distinct()
    touched = [r.b for r in gone.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return 0
    result = fresh
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(gone, key, "left_anti")
        result = old.unionByName(fresh, allowMissingColumns=True)
        result.sortWithinPartitions(*by).write.partitionBy("bucket").parquet(merged)
        result = spark.read.schema(_with_bucket(result)).parquet(merged)
    elif _moved(spark, staged, path):  # nothing stands there: no second copy
        return len(touched)
    left = {r.bucket for r in result.select("bucket").distinct().collect()}
    result.sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for empty in set(touched) - left:  # a bucket whose last document went
        remove(spark, f"{path}/bucket={empty}")
    for name in (staged, merged):  # all of it stands at ``path`` now
        remove(spark, name)
    return len(touched)


def _with_bucket(df: DataFrame) -> StructType:
    fields = [f for f in df.schema.fields if f.name != "bucket"]
    return StructType([*fields, StructField("bucket", IntegerType())])


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place  # noqa: SLF001


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder to where nothing is; False where another one was quicker, or the file system doesn't move."""
    context, place = spark.sparkContext, _place(spark, target)[1]
    fs = context._jvm.org.apache.hadoop.fs  # noqa: SLF001
    try:
        files = fs.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration())  # noqa: SLF001
        files.rename(_place(spark, source)[1], place, context._gateway.new_array(getattr(fs, "Options$Rename"), 0))  # noqa: SLF001
    except Py4JJavaError:
        return False
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at ``path``, on whichever file system."""
    system, place = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file at ``path``, if there is one."""
    system, place = _place(spark, path)
    system.delete(place, True)


def orphans(objects: DataFrame, references: list[DataFrame], now: Column, grace_hours: int = 24) -> DataFrame:
    """Objects (key, modified, ...) older than the grace period that none of the tables ``references`` (key) names."""
    used = references[0].select("key")
    for other in references[1:]:
        used = used.union(other.select("key"))
    old = objects.where(F.col("modified") < now - F.expr(f"INTERVAL {grace_hours} HOURS"))
    return old.join(used.where("key is not null").distinct(), "key", "left_anti")
