"""The sink for bundles as files: what a job leaves when it ends well, when it fails, and when a task is killed."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folioforge.sources.files import BundleWriter, write_files

SCHEMA = "bundle_id long, relative_path string, chunk int, body binary"


def tree(root):
    return {os.path.relpath(os.path.join(at, n), root): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(root) for n in names}


def rows(bundle, **files):
    return [(bundle, name.replace("__", "/") + ".md", 0, body) for name, body in files.items()]


def test_bundles_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    write_files(spark.createDataFrame(rows(1, index=b"one", references__a=b"a", references__b=b"b") + rows(2, index=b"two"), SCHEMA).repartition(3), root)
    write_files(spark.createDataFrame(rows(1, index=b"new", references__c=None), SCHEMA), root)
    assert tree(root) == {"1/index.md": b"new", "1/references/c.md": b"", "2/index.md": b"two"}
    write_files(spark.createDataFrame(rows(3, index=b"three"), SCHEMA), root, "overwrite")
    assert tree(root) == {"3/index.md": b"three"}
    write_files(spark.createDataFrame([], SCHEMA), root)
    assert tree(root) == {"3/index.md": b"three"} and os.listdir(root) == ["3"]


def test_chunks(spark, tmp_path):
    body = [bytes([k]) * 1000 for k in range(40)]
    given = [(b, f"assets/{b}.bin", k, body[k]) for b in range(3) for k in range(40)]
    write_files(spark.createDataFrame(given, SCHEMA).orderBy(F.rand(1)), str(tmp_path))
    assert tree(tmp_path) == {f"{b}/assets/{b}.bin": b"".join(body) for b in range(3)}


@pytest.mark.parametrize("bad", [[(1, "../2/index.md", 0, b"x")], [(1, "index.md", 0, b"x"), (1, "index.md", 0, b"y")], [(1, "index.md", 1, b"x")], [(1, "a.md", 0, b"x"), (1, "a.md", 2, b"y")]])
def test_a_failed_job_changes_nothing(spark, tmp_path, bad):
    root = str(tmp_path / "out")
    write_files(spark.createDataFrame(rows(1, index=b"old") + rows(2, index=b"old"), SCHEMA), root)
    before = tree(root)
    with pytest.raises(Exception, match="path leaves|written twice|out of turn"):
        write_files(spark.createDataFrame(rows(2, index=b"new") + bad, SCHEMA), root)
    assert tree(root) == before and sorted(os.listdir(root)) == ["1", "2"]


def test_a_file_from_two_tasks(spark, tmp_path):
    root = str(tmp_path / "out")
    given = spark.createDataFrame(rows(1, index=b"x") + rows(1, index=b"y"), SCHEMA).drop("chunk").repartition(2)
    with pytest.raises(Exception, match="written twice"):
        write_files(given, root)
    assert not os.path.exists(root) or tree(root) == {}


def test_an_attempt_that_is_lost(tmp_path):
    """Its folder is named by no message, so nothing of it is moved."""
    writer = BundleWriter(str(tmp_path), False)
    row = lambda path, body: {"bundle_id": 1, "relative_path": path, "chunk": 0, "body": body}

    def dies():
        yield row("index.md", b"half")
        yield row("lost.md", b"half")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    again = writer.write(iter([row("index.md", b"whole")]))
    writer.commit([again, None])
    assert tree(tmp_path) == {"1/index.md": b"whole"}


KILL = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from folioforge.session import ensure_importable
from folioforge.sources.files import write_files

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ensure_importable(spark)
rows = [(k % 4, f"p/{{k}}.md", b"x" * 50_000) for k in range(400)]

def dies(batches):
    for n, batch in enumerate(batches):
        yield batch
        if n == 5:
            try:
                os.close(os.open({flag!r}, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                continue
            os._exit(1)

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
frame = spark.createDataFrame(rows, "bundle_id long, relative_path string, body binary").repartition(2).mapInArrow(dies, "bundle_id long, relative_path string, body binary")
write_files(frame, {root!r})
"""


def test_a_killed_task(tmp_path):
    """A worker that dies in the middle of the first attempt: the job ends well, with every file whole and no other."""
    root, flag = str(tmp_path / "out"), str(tmp_path / "flag")
    os.makedirs(f"{root}/1")
    with open(f"{root}/1/stale.md", "w") as f:
        f.write("old")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", KILL.format(repo=repo, flag=flag, root=root)], capture_output=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert os.path.exists(flag) and tree(root) == {f"{k % 4}/p/{k}.md": b"x" * 50_000 for k in range(400)} and sorted(os.listdir(root)) == ["0", "1", "2", "3"]
