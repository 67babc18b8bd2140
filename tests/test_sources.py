"""The mounted inventory: batches and streams over a folder that changes."""

import os
import time

import pytest

from lakelens.functions.session import importable
from lakelens.operators import catalog
from lakelens.sources.files import inventory
from lakelens.sources.mounted import SCHEMA, Folder, MountedInventory, Share, listed, shares


def put(root, *paths, text="x"):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)


@pytest.fixture
def tree(spark, tmp_path):
    importable(spark)
    spark.dataSource.register(MountedInventory)
    root = tmp_path / "library"
    put(root, "a.txt", "one/b.JPG", "one/two/three/c.tar.gz", "one/#recycle/gone.txt", "@eaDir/x/y.txt", "one/._b.jpg", ".import-7/z.txt", "noext", "ü/d e.txt")
    os.symlink(root / "one", root / "link")
    os.symlink(root / "a.txt", root / "alias.txt")
    return root


def test_batch(spark, tree):
    rows = spark.read.format("mounted_inventory").option("library_id", 5).load(str(tree)).collect()
    want = {"a.txt": ("txt", "text/plain"), "one/b.JPG": ("jpg", "image/jpeg"), "one/two/three/c.tar.gz": ("gz", "application/x-tar"), "noext": ("", None), "ü/d e.txt": ("txt", "text/plain")}
    assert {r.relative_path: (r.extension, r.mime) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        s = os.stat(tree / r.relative_path)
        assert (r.library_id, r.path, r.size, r.mtime_s, r.inode, r.error) == (5, f"{tree}/{r.relative_path}", s.st_size, int(s.st_mtime), s.st_ino, None)
    assert spark.read.format("mounted_inventory").load(f"file://{tree}").count() == len(want)
    # the same files as the inventory of any store
    os.unlink(tree / "link")
    os.unlink(tree / "alias.txt")
    assert {os.path.basename(r.path) for r in inventory(spark, str(tree), 5).collect()} >= {r.name for r in rows if " " not in r.name}


@pytest.mark.parametrize("tasks", [1, 2, 3, 50])
def test_shares_hold_every_file_once(tmp_path, tasks):
    put(tmp_path, *[f"{i}/{j}/{k}.txt" for i in range(4) for j in range(3) for k in range(2)], *[f"deep/{'d/' * n}f" for n in range(30)], "top")
    parts = shares(str(tmp_path), tasks, 0, 2**62)
    found = [r[2] for p in parts for r in listed(p, str(tmp_path), 1)]
    assert len(parts) <= tasks and len(found) == len(set(found)) == 4 * 3 * 2 + 30 + 1


def test_errors_are_rows(spark, tree):
    missing = Share([Folder(f"{tree}/no", True, True, False)], 0, 2**62)
    (row,) = listed(missing, str(tree), 1)
    assert row[2] == "no" and row[6] is None and "No such file" in row[-1] and len(row) == len(SCHEMA.split(","))
    gone = spark.read.format("mounted_inventory").load(f"{tree}/no").collect()
    assert [r.error for r in gone] == ["No such file or directory"]
    with pytest.raises(ValueError):
        MountedInventory({"path": "viewfs://x/y"}).reader(None)


def test_stream_of_additions_changes_and_moves(spark, tree, tmp_path):
    at = str(tmp_path / "checkpoint")
    seen = []

    def turn():
        time.sleep(0.3)
        new = []
        stream = spark.readStream.format("mounted_inventory").options(settle_s=0.1, tasks=3).load(str(tree))
        job = stream.writeStream.foreachBatch(lambda df, n: new.extend(r.relative_path for r in df.collect())).option("checkpointLocation", at).trigger(availableNow=True).start()
        job.awaitTermination(120)
        seen.extend(new)
        return sorted(new)

    assert turn() == ["a.txt", "noext", "one/b.JPG", "one/two/three/c.tar.gz", "ü/d e.txt"]
    assert turn() == []
    put(tree, "one/two/new.txt")
    put(tree, "a.txt", text="longer")
    assert turn() == ["a.txt", "one/two/new.txt"]
    # two folders that change one below the other: what the lower one holds may come again
    put(tree, "one/@eaDir/no.txt", "one/two/more.txt")
    assert {"one/two/more.txt"} <= set(turn()) <= {"one/two/more.txt", "one/two/new.txt", "one/two/three/c.tar.gz"}
    # a folder with old files moves in, and one of them moves within it
    put(tmp_path / "outside", "old/1.txt", "old/in/2.txt", "old/in/#snapshot/3.txt")
    time.sleep(0.5)
    assert turn() == []
    os.rename(tmp_path / "outside" / "old", tree / "one" / "moved")
    put(tree, "one/moved/4.txt")
    assert turn() == ["one/moved/1.txt", "one/moved/4.txt", "one/moved/in/2.txt"]
    os.rename(tree / "one/moved/1.txt", tree / "one/moved/in/1.txt")
    assert "one/moved/in/1.txt" in turn()
    os.unlink(tree / "noext")
    assert turn() == []
    # a full scan against what the stream has seen names the files that are gone
    scan = spark.read.format("mounted_inventory").load(str(tree)).withColumnRenamed("relative_path", "p").select(catalog.F.col("p").alias("path"))
    known = spark.createDataFrame([(p,) for p in set(seen)], "path string")
    assert sorted(r.path for r in catalog.missing(known, scan).collect()) == ["noext", "one/moved/1.txt"]
