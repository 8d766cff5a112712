"""Sinks (SNK01, SNK05-SNK06, SNK12, SNK14-SNK15, UPS11)."""

from __future__ import annotations

import io
import time
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage


def write_snapshot(df: DataFrame, path: str) -> None:
    """SNK01, SNK12: replaces a table by the commit protocol."""
    df.write.mode("overwrite").parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    """SNK07: a run's partition; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_texts(docs: DataFrame, path: str, text: str = "markdown") -> None:
    """SNK03-SNK05: one text a document, partitioned by document."""
    docs.select("doc_id", F.col(text).alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)


def bundle_manifest(files: DataFrame, own: str) -> DataFrame:
    """SNK06: relative paths in order without the bundle itself."""
    return files.where(F.col("path") != own).select("path", "bytes", "sha256").orderBy("path")


def bundle(files: list[tuple[str, bytes]]) -> bytes:
    """SNK06: a ZIP of one paper's files, in order of their paths."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in sorted(files):
            z.writestr(zipfile.ZipInfo(path), data)
    return out.getvalue()


def content_type(path: Column) -> Column:
    """SNK14."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"html": "text/html; charset=utf-8", "md": "text/markdown; charset=utf-8", "json": "application/json", "png": "image/png", "pdf": "application/pdf", "zip": "application/zip"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), ext), F.lit("application/octet-stream"))


def page_map(pages: Column, dual: Column) -> Column:
    """SNK15: output pages of each source page, one or two."""
    return F.transform(F.sequence(F.lit(1), pages), lambda p: F.when(dual, F.array(2 * p - 1, 2 * p)).otherwise(F.array(p)))


def claim(spark: SparkSession, path: str, owner: str, stale_seconds: float = 3600) -> bool:
    """UPS11: take a lock file; False while somebody else holds it.

    The file system creates it for one caller only.  A lock older than ``stale_seconds`` is moved aside, which
    again succeeds for one caller only, and taken anew.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not storage.create_new(spark, path):
        age = time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else 0
        if age <= stale_seconds or not fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}.stale-{uuid.uuid4().hex}")):
            return False
        if not storage.create_new(spark, path):
            return False
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}.owner"), True)
    out.writeBytes(owner)
    out.close()
    return True


def release(spark: SparkSession, path: str, owner: str) -> bool:
    """UPS11: give a lock back; False where it is another's."""
    jvm = spark.sparkContext._jvm
    p, o = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.owner")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(o):
        return False
    held = fs.open(o)
    found = bytes(held.readAllBytes()).decode()
    held.close()
    return found == owner and fs.delete(o, False) and fs.delete(p, False)
