"""Document files as rows, with a gate for what can be read."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".png", ".jpg", ".jpeg", ".pdf")
# How the files begin, in hex.
MAGIC = {".png": "89504E47", ".jpg": "FFD8FF", ".jpeg": "FFD8FF", ".pdf": "25504446"}


def load_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, suffix, content, sha1, error: every file of a folder in order of its path; the bad ones say why."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    # Spark's reader leaves out files without a byte; the listing names them
    empty = [(p, bytearray()) for p in _empty_files(spark, path) if fnmatch(p.rsplit("/", 1)[-1], glob)]
    return gate(files.unionByName(spark.createDataFrame(empty, "path string, content binary")))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append(status.getPath().toString())
    return found


def gate(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))
    begins = F.lit(False)
    for suffix, magic in MAGIC.items():
        begins = begins | ((F.col("suffix") == suffix) & F.hex(F.substring("content", 1, 4)).startswith(magic))
    error = F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("unsupported file type "), "suffix")).when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty file").when(~begins, "could not decode the file")
    return rows.withColumn("sha1", F.sha1("content")).withColumn("error", error).select("path", "name", "suffix", "content", "sha1", "error")


def split_errors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that go on, and (name, error) of the others; one bad file never stops a batch."""
    return files.where("error IS NULL").drop("error"), files.where("error IS NOT NULL").select("name", "error")
