"""Results written to files: only what is approved and passed its check, never over an original."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(results: DataFrame) -> Column:
    """Whether a result may be exported: approved, checked or forced by the user, of content that may be processed."""
    c = F.col
    return F.coalesce(c("approved") & (c("passed") | c("forced")) & ~c("needs_password") & (~c("signed") | c("signature_confirmed")), F.lit(False))


def planned(results: DataFrame, existing: DataFrame, folder: str, suffix: str = "_clean", conflict: str = "number") -> DataFrame:
    """`results` (path, root, ext, ...) with target and action: write, skip, replace or refuse.

    The folders below the import root are kept. `existing` (path) are files there already; with `number` a name that is
    taken gets (2), (3) and so on, counted over results of one name and what exists. A target that is its own original
    is refused."""
    if conflict not in ("number", "skip", "replace"):
        raise ValueError(conflict)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    below = F.when(F.col("root").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.element_at(F.split("root", "/"), -1), F.expr("substring(regexp_replace(path, '/[^/]*$', ''), length(root) + 1)")))
    base = F.concat(F.lit(folder.rstrip("/")), below, F.lit("/"), stem, F.lit(suffix)) if folder else F.concat(parent, F.lit("/"), stem, F.lit(suffix))
    rows = results.withColumns({"base": base, "first": F.concat(base, F.lit("."), F.col("ext"))})
    taken = existing.select(F.regexp_replace("path", r"( \(\d+\))?\.[^./]*$", "").alias("base"), F.element_at(F.split("path", r"\."), -1).alias("ext"), F.coalesce(F.try_to_number(F.regexp_extract("path", r" \((\d+)\)\.[^./]*$", 1), F.lit("999999")).cast("int"), F.lit(1)).alias("n"))
    last = taken.groupBy("base", "ext").agg(F.max("n").alias("last"))
    rows = rows.join(last, ["base", "ext"], "left")
    k = F.row_number().over(Window.partitionBy("first").orderBy("path")) + F.coalesce("last", F.lit(0))
    numbered = F.when(k == 1, F.col("first")).otherwise(F.concat("base", F.lit(" ("), k, F.lit(")."), "ext"))
    clash = F.col("last").isNotNull()
    if conflict == "number":
        target, action = numbered, F.lit("write")
    else:
        target, action = F.col("first"), F.when(clash, conflict).otherwise("write")
    return rows.withColumns({"target": target, "action": F.when(target == F.col("path"), "refuse").otherwise(action)}).drop("base", "first", "last")


def commit(path: str, data: bytes, replace: bool = False) -> str:
    """Writes a file as a whole or not at all: a temporary file beside it, synced, then linked, which never clobbers, or
    moved over it if it may be replaced. Returns written or exists."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(temporary, path)
            return "written"
        try:
            os.link(temporary, path)
        except FileExistsError:
            with open(path, "rb") as f:
                return "written" if f.read() == data else "exists"
        return "written"
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for target, action, data in zip(batch["target"], batch["action"], batch["content"]):
            out.append({"target": target, "outcome": commit(target, bytes(data), action == "replace") if action in ("write", "replace") else action})
        yield pd.DataFrame(out, columns=["target", "outcome"])


def export(results: DataFrame) -> DataFrame:
    """(target, outcome) of planned results (target, action, content, and what `allowed` reads). Rows that may not be
    exported are left out before their content is read. A task that runs again finds its file written and says so.
    Targets are on a file system that all executors mount."""
    rows = results.where(allowed(results)).select("target", "action", "content")
    return rows.mapInPandas(_written, "target string, outcome string")
