"""Finding raw workloads and checking their files against published checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blocktrace.schemas import RAW_ORDER
from blocktrace.sources.raw import read_lines

# Names that are never traces, and unfinished or packed files.
NOT_TRACES = ["readme.txt", "readme.md", "md5.txt", "disclaimer.txt", ".gitkeep", "download_manifest.json"]
ARCHIVES = [".tar", ".tar.gz", ".tar.xz", ".tgz", ".zip"]
UNFINISHED = [".part", ".tmp", ".crdownload"]
COMPRESSED = r"\.(gz|bz2|xz|lzma)$"
SYSTOR_FILE = r"(?i)^(\d{10})-(LUN\d+)\.csv(\.gz)?$"
DATASETS = ["msr", "systor", "fiu"]
#: Bytes of a file that are read at once to be hashed.
READ_BYTES = 8 << 20


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes below a dataset folder; file contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listed.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))


def _stem(name: Column) -> Column:
    plain = F.regexp_replace(name, COMPRESSED, "")
    return F.replace(F.regexp_replace(plain, r"(?<=.)\.[^.]*$", ""), F.lit(" "), F.lit("_"))


def discover(files: DataFrame, dataset: str) -> DataFrame:
    """Trace files of a dataset as (dataset, trace_id, file_index, path) rows.

    Hourly SYSTOR files of one LUN form one workload, in name order, which is
    chronological. Any other file is a workload of its own.
    """
    name = F.lower("name")
    wanted = files.filter(~name.isin(NOT_TRACES))
    for suffix in [*ARCHIVES, *UNFINISHED]:
        wanted = wanted.filter(~name.endswith(suffix))
    if dataset == "systor":
        lun = F.lower(F.regexp_extract("name", SYSTOR_FILE, 2))
        wanted = wanted.withColumn("_id", lun).filter(F.col("_id") != "")
    else:
        wanted = wanted.withColumn("_id", _stem(F.col("name")))
    order = Window.partitionBy("trace_id").orderBy("path")
    return wanted.select(
        F.lit(dataset).alias("dataset"), F.concat(F.lit(f"{dataset}_"), F.col("_id")).alias("trace_id"),
        "path", "length").withColumn("file_index", F.row_number().over(order) - 1)


def digests(files: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """MD5 and SHA-256 of each file of a listing (`path`, `length`), in one pass over its blocks.

    A file is one task's row and is never whole in memory, so its size has no
    limit. Paths are opened through the file systems that Arrow knows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, place = fs.FileSystem.from_uri(_uri(path))
                md5, sha256 = hashlib.md5(usedforsecurity=False), hashlib.sha256()
                with system.open_input_stream(place, compression=None) as stream:
                    while block := stream.read(read_bytes):
                        md5.update(block)
                        sha256.update(block)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "md5": [md5.hexdigest()],
                                                  "sha256": [sha256.hexdigest()]})

    return files.select("path", "length").repartition("path").mapInArrow(
        hashed, "path string, length long, md5 string, sha256 string")


def write_files(files: DataFrame, folder: str) -> None:
    """One small file for each `name` below `folder`, written by the tasks; it holds `value`, or else its name.

    A name may have folders in front.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(_uri(folder))
        made = set()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                above = f"{place}/{name}".rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(f"{place}/{name}", compression=None) as stream:
                    stream.write(value.encode())
            yield batch.select(["name"])

    value = "value" if "value" in files.columns else F.col("name").alias("value")
    files.select("name", value).mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def _uri(path: str) -> str:
    """Paths are listed plainly; as part of an address their special characters are encoded."""
    from urllib.parse import quote

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return "file://" + quote(path)
    # A local path is listed with one slash after its scheme.
    return f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest)}"


def read_checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A published list of ``digest *name`` lines, MD5 or SHA-256; the last line of a name counts."""
    return parse_checksums(read_lines(spark, path))


def parse_checksums(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("line"), r"\s+")
    listed = lines.withColumn("_p", parts).filter(F.size("_p") >= 2).select(
        F.regexp_replace(F.element_at("_p", -1), r"^\*+", "").alias("name"),
        F.lower(F.element_at("_p", 1)).alias("expected"), *RAW_ORDER)
    return listed.groupBy("name").agg(F.max_by("expected", F.struct(*RAW_ORDER)).alias("expected"))


def file_name(path: Column, depth: int = 1) -> Column:
    """The last `depth` parts of a path."""
    return F.substring_index(path, "/", -depth)


def verify_checksums(spark: SparkSession, folder: str, published: DataFrame, depth: int = 1) -> DataFrame:
    """OK, FAILED or UNVERIFIED for each file below `folder`, with both digests.

    `depth` path parts form the published name. A published digest of 64 digits
    is SHA-256, any other one MD5.
    """
    hashed = digests(list_files(spark, folder)).select(
        file_name(F.col("path"), depth).alias("name"), "length", "md5", "sha256")
    hashed = hashed.join(published, "name", "left").withColumn(
        "actual", F.when(F.length("expected") == 64, F.col("sha256")).otherwise(F.col("md5")))
    status = (F.when(F.col("expected").isNull(), "UNVERIFIED")
              .when(F.col("expected") == F.col("actual"), "OK").otherwise("FAILED"))
    return hashed.withColumn("status", status)
