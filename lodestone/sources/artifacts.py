"""Sinks and artifacts: written once under a signature, found again by it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(**config) -> str:
    """A hash of a stage's configuration and inputs."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """A hash of the rows in any order: the sum of their hashes, and their number."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")
    total, n = df.agg(F.sum(row), F.count(F.lit(1))).head()
    return f"{int(total or 0) % (1 << 128):032x}-{n}"


def reuse_or_write(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The rows under a key; made and written first if there are none. Spark's commit makes the write whole or nothing."""
    path = f"{root}/{key}"
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(root), spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Gzipped JSON lines in order, nulls left out."""
    df.orderBy(order).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true").json(path)


def digest(spark: SparkSession, path: str) -> str:
    """sha256 over the sorted names and contents' hashes of a folder's files, or of one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("hash")).where("name not like '\\_%' and name not like '.%'").orderBy("name", "hash").collect()  # a row per file
    return hashlib.sha256("\n".join(f"{r['name']} {r['hash']}" for r in rows).encode()).hexdigest()


def verified(spark: SparkSession, path: str, expected: str) -> str:
    """The path, if its content has the expected digest; else ValueError."""
    found = digest(spark, path)
    if found != expected:
        raise ValueError(f"{path}: digest {found} instead of {expected}")
    return path


def rows_in(spark: SparkSession, path: str) -> int:
    """Lines that are not blank in JSON lines, plain or gzipped."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def gzipped(spark: SparkSession, plain: str, to: str) -> int:
    """Write plain lines anew as gzip, unless that was done before; the number of lines there."""
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(to), spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{to}/_SUCCESS")):
        spark.read.text(plain).write.mode("overwrite").option("compression", "gzip").text(to)
    return rows_in(spark, to)


def cached_paths(papers: DataFrame, manifest: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """papers (paper) with the path of their cached text: the recorded one, else <paper>.bioc.json or its gzip; null for
    paths outside the root or without a file. manifest: (paper, path), files: (path)."""
    named = papers.join(manifest.select("paper", F.col("path").alias("recorded")), "paper", "left")
    tried = named.select("paper", F.posexplode(F.array(F.col("recorded"), F.concat(F.lit(f"{root}/"), "paper", F.lit(".bioc.json")), F.concat(F.lit(f"{root}/"), "paper", F.lit(".bioc.json.gz")))).alias("order", "path"))
    inside = tried.where(F.col("path").startswith(f"{root}/") & ~F.col("path").contains("/../"))
    best = inside.join(files.select("path").distinct(), "path", "left_semi").groupBy("paper").agg(F.min_by("path", "order").alias("path"))
    return papers.select("paper").join(best, "paper", "left")
