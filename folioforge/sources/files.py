"""A sink for bundles as files that commits: df.write.format("folioforge_bundles").save(folder)."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "folioforge_bundles"
#: bundle_id names the folder; a file's bytes may come in several rows, chunk by chunk.
COLUMNS = ("bundle_id", "relative_path", "chunk", "body")
#: Folders renamed at once on commit.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has put its files, and the bundles they belong to."""

    folder: str
    bundles: list[str] = field(default_factory=list)


def inside(folder: str, relative: str) -> str:
    """The path of a file in a folder, which it may not leave."""
    path = os.path.normpath(os.path.join(folder, relative))
    if not path.startswith(folder + os.sep):
        raise ValueError(f"path leaves the bundle: {relative}")
    return path


class BundleFiles(DataSource):
    """Files below path/<bundle_id>/. Mode append replaces the bundles that are written and leaves the others, overwrite removes those too."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        if missing := {"bundle_id", "relative_path", "body"} - set(schema.names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return BundleWriter(os.path.abspath(self.options["path"]), overwrite)


class BundleWriter(DataSourceWriter):
    """Tasks write to folders of their own below one staging folder; the driver moves whole bundles into place once all have ended well.

    A task that is lost or runs twice leaves a staging folder that no message
    names: it goes with the rest. A failed job leaves the target as it was.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = os.path.join(root, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Staged:
        """Rows with a chunk are sorted by bundle, path and chunk; whole files come in any order. A file that comes twice is an error, as is a chunk out of turn."""
        own = Staged(os.path.join(self.staging, uuid.uuid4().hex))
        bundles: set[str] = set()
        at: tuple[str, int] | None = None
        open_file = None
        try:
            for row in iterator:
                bundle = str(row["bundle_id"])
                path = inside(inside(own.folder, bundle), row["relative_path"])
                chunk = row["chunk"] if "chunk" in row else 0
                if at is not None and at[0] == path and chunk == at[1] + 1:
                    at = (path, chunk)
                else:
                    if open_file is not None:
                        open_file.close()
                    if chunk or os.path.exists(path):
                        raise ValueError(f"{'chunk out of turn' if chunk else 'file written twice'}: {bundle}/{row['relative_path']}")
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    open_file, at = open(path, "wb"), (path, 0)
                    bundles.add(bundle)
                open_file.write(row["body"] or b"")
        finally:
            if open_file is not None:
                open_file.close()
        own.bundles = sorted(bundles)
        return own

    def commit(self, messages: list[Staged | None]) -> None:
        parts: dict[str, list[str]] = {}
        for m in messages:
            for bundle in m.bundles if m is not None else ():
                parts.setdefault(bundle, []).append(os.path.join(m.folder, bundle))
        os.makedirs(self.staging, exist_ok=True)
        # all parts are put together before any bundle is replaced: a file written by two tasks spoils the job, not the target
        with ThreadPoolExecutor(MOVERS) as pool:
            whole = dict(zip(parts, pool.map(_joined, parts.values())))
            list(pool.map(self._replace, whole.items()))
        if self.overwrite:
            for name in os.listdir(self.root):
                if name not in whole and not name.startswith(".staging-"):
                    os.rename(os.path.join(self.root, name), os.path.join(self.staging, f"old-{name}"))
        shutil.rmtree(self.staging)

    def _replace(self, bundle_and_folder: tuple[str, str]) -> None:
        bundle, folder = bundle_and_folder
        target = os.path.join(self.root, bundle)
        if os.path.lexists(target):
            os.rename(target, os.path.join(self.staging, f"old-{bundle}"))
        os.rename(folder, target)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _joined(folders: list[str]) -> str:
    """One folder with the files of all: those of the others are moved into the first."""
    first, *others = folders
    for other in others:
        for at, _, names in os.walk(other):
            to = os.path.normpath(os.path.join(first, os.path.relpath(at, other)))
            os.makedirs(to, exist_ok=True)
            for name in names:
                target = os.path.join(to, name)
                if os.path.exists(target):
                    raise ValueError(f"file written twice: {os.path.relpath(target, os.path.dirname(first))}")
                os.rename(os.path.join(at, name), target)
    return first


def write_files(files: DataFrame, root: str, mode: str = "append") -> None:
    """Write rows (bundle_id, relative_path, body, maybe chunk) as files below root, on storage that driver and executors see as a path.

    The files of a bundle need not be in one task, but the chunks of a file do:
    rows are dealt out by bundle and path.
    """
    spark = files.sparkSession
    register(spark)
    if "chunk" in files.columns:
        files = files.repartition("bundle_id", "relative_path").sortWithinPartitions("bundle_id", "relative_path", "chunk")
    files.select(*[c for c in COLUMNS if c in files.columns]).write.format(FORMAT).mode(mode).save(root)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleFiles)
