"""Bundles as files, for people; as Parquet, for pipelines."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources import files


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path, in place of what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def pretty_manifest(compact: str) -> str:
    return json.dumps(json.loads(compact), indent=2, ensure_ascii=False) + "\n"


def bundle_files(tables: dict[str, DataFrame]) -> DataFrame:
    """All files of all bundles: bundle_id, relative_path, chunk, body; long ones chunk by chunk."""
    text = tables["rendered"].select("bundle_id", "relative_path", F.lit(0).alias("chunk"), F.col("markdown").cast("binary").alias("body"))
    manifest = tables["manifest_files"].select("bundle_id", F.lit("references/references.json").alias("relative_path"), "chunk", F.col("text").cast("binary").alias("body"))
    return text.unionByName(manifest).unionByName(tables["files"].select("bundle_id", "relative_path", "chunk", "body"))


def write_files(tables: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """All bundles' files below root/<bundle_id>/ on storage that all executors see as a path, written by the executors.

    Bundles are replaced when all their files are written, so none keeps files
    of an earlier state; if a task fails for good, nothing changes.
    """
    files.write_files(bundle_files(tables), root, mode)


def write_bundle(tables: dict[str, DataFrame], bundle_id: int, out_dir: str) -> None:
    """One bundle's files in out_dir, which they replace when all are written, by the executors.

    tables: rendered (bundle_id, relative_path, markdown), files (bundle_id,
    relative_path, chunk, body), manifest_files (bundle_id, chunk, text).
    """
    parent = os.path.dirname(os.path.abspath(out_dir))
    os.makedirs(parent, exist_ok=True)
    made = tempfile.mkdtemp(prefix=".bundle-", dir=parent)
    try:
        write_files({name: tables[name].where(f"bundle_id = {int(bundle_id)}") for name in ("rendered", "files", "manifest_files")}, made)
        done = os.path.join(made, str(int(bundle_id)))
        for folder in ("assets", "references"):
            os.makedirs(os.path.join(done, folder), exist_ok=True)
        if os.path.isdir(out_dir):
            os.rename(out_dir, os.path.join(made, "old"))
        os.rename(done, out_dir)
    finally:
        shutil.rmtree(made, ignore_errors=True)
