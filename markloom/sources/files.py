"""Import of files and folders: what can be read, in natural order, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import scalars


def listing(spark: SparkSession, *paths: str, content: bool = True) -> DataFrame:
    """(path, modificationTime, length[, content]) of all files below the paths. Content is only read if asked for.
    Files of no bytes and hidden ones aren't listed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return rows if content else rows.drop("content")


def import_files(files: DataFrame, workspace: DataFrame | None = None) -> DataFrame:
    """(path, name, kind, size, fingerprint, state, error, sort_key) of `files` (path, length, content) that can be read.

    Known media that isn't supported and files of other content are failed rows, not lost ones; files of other kinds are left out.
    Paths that the workspace (path) has, and repeated ones, are dropped. sort_key orders names naturally."""
    path = F.col("path")
    kind = scalars.media_kind(path)
    rows = files.dropDuplicates(["path"]).where(kind.isNotNull())
    if workspace is not None:
        rows = rows.join(workspace.select("path").distinct(), "path", "left_anti")
    found = scalars.sniffed(F.col("content"))
    wrong = F.when(kind == "unsupported", "unsupported_format").when(F.col("length") == 0, "io").when((kind == "pdf") != F.coalesce(found == "pdf", F.lit(False)), "decode").when(found.isNull(), "decode")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        "path", name.alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("fingerprint"),
        F.when(wrong.isNull(), "queued").otherwise("failed").alias("state"), wrong.alias("error"), scalars.natural_key(name).alias("sort_key"),
    )
