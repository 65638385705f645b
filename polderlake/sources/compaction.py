"""Small files packed into fewer, behind a list of what counts.

A compaction writes the rows of many small files into a folder of its own below ``_packed`` and
then a list, ``_packed/lists/<n>``, of the files that it stands for. Spark passes over names that
start with an underscore, so writers go on appending beside it and know nothing of it.
``read_packed`` reads what complete lists stand for and the files that none names. Nothing is
removed until ``expire``, so a reader that began before keeps its files, and a compaction that
failed leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polderlake.session import scratch_path

LISTED = "path string, length long, folder string, label string"
TARGET = 256 << 20


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, folder`` of the files of a table, without reading them.

    ``folder`` is the part of the path between the table and the file, empty at the top.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(root).toUri().getPath().rstrip("/")
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length"))
    below = F.substring_index("path", f"{top}/", -1)
    return found.withColumn("folder", F.regexp_replace(below, r"/?[^/]*$", ""))


def pack(files: DataFrame, target: int = TARGET, block_files: int = 100_000) -> DataFrame:
    """Add ``bin``: files of a folder below the target size, in bins of about that many bytes.

    A folder's files are dealt by a hash of their name to as many blocks as hold some
    ``block_files`` each, so no task sorts more, and the running sum of bytes in a block decides
    the cuts: a file belongs to the bin in which it starts, so a bin holds less than the target
    and one small file. Files of the target size and more have a null bin: they stay.
    """
    small = files.where(F.col("length") < target)
    blocks = small.groupBy("folder").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_files)).alias("_blocks"))
    dealt = small.join(blocks, "folder").withColumn("_block", F.expr("pmod(xxhash64(path), _blocks)"))
    before = Window.partitionBy("folder", "_block").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    binned = dealt.withColumn("_cut", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        *files.columns, F.concat_ws("-", "_block", F.expr(f"_cut div {int(target)}")).alias("bin"))
    return binned.unionByName(files.where(F.col("length") >= target).withColumn(
        "bin", F.lit(None).cast("string")))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Complete compactions, oldest first."""
    folder, fs = _folder(spark, f"{path}/_packed/lists")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    mark = lambda n: _folder(spark, f"{path}/_packed/lists/{n}/_SUCCESS")[0]
    return sorted(int(n) for n in names if fs.exists(mark(n)))


def _listed(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(LISTED).parquet(f"{path}/_packed/lists/{generation:06d}")


def _loose(spark: SparkSession, path: str) -> DataFrame:
    """Files that no complete list names."""
    files = data_files(spark, path)
    for g in generations(spark, path):
        files = files.join(_listed(spark, path, g), "path", "left_anti")
    return files


def _rows(spark: SparkSession, path: str, files: DataFrame, schema: StructType) -> DataFrame:
    """Rows of the chosen files and no others, folder columns (``batch_id=7``) included.

    Their names pass the driver, as those of every table that Spark reads do.
    """
    names = [r["path"] for r in files.select("path").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*names)


def compact(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = (),
            settled: Column | None = None, target: int = TARGET) -> dict[str, int]:
    """Pack the loose small files of a table; returns ``files``, ``bins`` and ``generation``.

    ``schema`` is the table's, with its folder columns, which ``partition_by`` names. Only files
    that share a bin with another are read and rewritten; without such files nothing is written.
    ``settled`` is a condition on ``folder``: what may still be replaced, such as the last
    batch of a stream, must be left out. There is one compaction at a time; a second one that
    races it fails when it writes the same generation.
    """
    loose = _loose(spark, path)
    packed = pack(loose if settled is None else loose.where(settled), target)
    company = (packed.where("bin IS NOT NULL").groupBy("folder", "bin")
               .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    done = generations(spark, path)
    plan = scratch_path(spark, "compaction")
    packed.join(company, ["folder", "bin"]).select("path", "length", "folder", "bin").write.parquet(plan)
    chosen = spark.read.parquet(plan)
    counts = chosen.agg(F.count(F.lit(1)).alias("files"),
                        F.count_distinct("folder", "bin").alias("bins")).first()
    if not counts["files"]:
        return {"files": 0, "bins": 0, "generation": done[-1] if done else -1}
    generation = done[-1] + 1 if done else 0
    rows = _rows(spark, path, chosen, schema)
    # Folders meet in a task so that each gets few files; a large one is split again by its size.
    out = (rows.hint("rebalance", *partition_by).write.partitionBy(*partition_by) if partition_by
           else rows.coalesce(counts["bins"]).write)
    label = f"{generation:06d}-{uuid.uuid4().hex[:12]}"
    out.parquet(f"{path}/_packed/{label}")
    chosen.select("path", "length", "folder", F.lit(label).alias("label")).write.mode(
        "errorifexists").parquet(f"{path}/_packed/lists/{generation:06d}")
    return {"files": counts["files"], "bins": counts["bins"], "generation": generation}


def compact_batches(spark: SparkSession, path: str, schema: StructType, last_batch: int,
                    target: int = TARGET) -> dict[str, int]:
    """``compact`` for the batch folders of a stream up to a batch that its checkpoint committed.

    A later batch may run again and replace its folder, so it is not touched.
    """
    batch = F.regexp_extract("folder", r"^batch_id=(\d+)$", 1)
    return compact(spark, path, schema, ["batch_id"],
                   (batch != "") & (batch.try_cast("long") <= last_batch), target)


def read_packed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table: all complete generations and the files that none of them stands for."""
    done = generations(spark, path)
    if not done:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    parts = _rows(spark, path, _loose(spark, path), schema).select(*schema.fieldNames())
    for g in done:
        whole = f"{path}/_packed/{_listed(spark, path, g).first()['label']}"
        rows = spark.read.schema(schema).option("basePath", whole).parquet(whole)
        parts = parts.unionByName(rows.select(*schema.fieldNames()))
    return parts


def expire(spark: SparkSession, path: str) -> int:
    """Remove the files that complete generations stand for; readers of them must be done."""
    gone = 0
    for g in generations(spark, path):
        for r in _listed(spark, path, g).toLocalIterator():
            file, fs = _folder(spark, r["path"])
            gone += bool(fs.delete(file, False))
    return gone
