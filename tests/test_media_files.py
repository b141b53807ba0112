"""Media files are written and listed by tasks, each a plain file by its own name."""

import os

import pytest
from test_queries import SF, db  # noqa: F401  (db is a fixture)

import __spark_entry__ as entry
from tideline.plans import scans
from tideline.sources import files as IO

PART = "part-00000-0123abcd-0123-0123-0123-0123456789ab.c000.txt"  # as Spark names its files


@pytest.mark.parametrize("name", ["media_inventory", "media_inventory_all"])
def test_a_media_file_costs_one_file(spark, db, tmp_path, monkeypatch, name):  # noqa: F811
    """No folder, checksum file or move for each: these were four processes a file."""
    monkeypatch.setattr(scans.IO, "shared_folder", lambda _: f"file://{tmp_path}/out")
    got = sorted(tuple(r) for r in entry.queries()[name](spark, SF).select("stem", "ext").collect())
    videos = [v for (v,) in db.execute("select distinct user_id from events").fetchall()]
    names = [f for _, _, files in os.walk(tmp_path) for f in files]
    assert sorted(names) == sorted(f"v{v}.{e}" for v in videos for e in (("mp4", "webm", "txt") if v % 2 == 0 else ("mp4", "txt")))
    assert all(open(f"{d}/{f}").read() == "x\n" for d, _, files in os.walk(tmp_path) for f in files)
    assert len([d for _, folders, _ in os.walk(tmp_path) for d in folders]) <= 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == sorted(db.execute(f"select stem, ext from ({entry.oracle_sql()[name]})").fetchall())


def test_inventory_of_any_folder(spark, tmp_path):
    """Files by their own names, at any depth, and Spark's files in folders of the name; what Spark's readers don't see is left out."""
    seen = ["a.mp4", "a.webm", "d.d/b.webm", "d.d/e/b.mp4", "d.d/e/f/c c%20é.mp4", "k=1/two.dots.mp4", "_k=1/g.webm", f"file=h.mp4/{PART}", f"z.mp4/{PART}", "v.webm/part-1.mp4", "part-2.webm"]
    unseen = ["a.txt", "noext", "UP.MP4", "_i.mp4", ".j.mp4", "_l/m.mp4", ".n/o.mp4", "p.mp4._COPYING_", "empty.mp4"]
    for f in seen + unseen:
        os.makedirs(os.path.dirname(f"{tmp_path}/{f}"), exist_ok=True)
        with open(f"{tmp_path}/{f}", "w") as out:
            out.write("" if f == "empty.mp4" else "xyz")
    os.symlink(f"{tmp_path}/nowhere", f"{tmp_path}/q.mp4")
    os.symlink(f"{tmp_path}/d.d/b.webm", f"{tmp_path}/r.webm")
    want = [("a", "webm", "a.webm"), ("b", "webm", "d.d/b.webm"), ("c c%20é", "mp4", "d.d/e/f/c c%20é.mp4"), ("two.dots", "mp4", "k=1/two.dots.mp4"), ("g", "webm", "_k=1/g.webm"), ("file=h", "mp4", f"file=h.mp4/{PART}")]
    want += [("z", "mp4", f"z.mp4/{PART}"), ("part-1", "mp4", "v.webm/part-1.mp4"), ("part-2", "webm", "part-2.webm"), ("r", "webm", "r.webm")]
    got = {(r.stem, r.ext, r.path, r.length) for r in IO.media_inventory(spark, str(tmp_path)).collect()}
    assert got == {(s, e, f"file:{tmp_path}/{p}", 3) for s, e, p in want}
    spark_sees = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length")
    assert sorted(map(tuple, IO.list_files(spark, f"file://{tmp_path}").collect())) == sorted(map(tuple, spark_sees.collect()))


def test_stores_that_only_spark_reaches(spark, db, monkeypatch):  # noqa: F811
    """There Spark writes a folder for each file, and lists them."""
    monkeypatch.setattr(IO, "mounted", lambda *_: None, raising=False)
    got = sorted(tuple(r) for r in entry.queries()["media_inventory"](spark, SF).select("stem", "ext").collect())
    assert got == sorted(db.execute(f"select stem, ext from ({entry.oracle_sql()['media_inventory']})").fetchall())


def test_a_folder_is_written_once(spark, tmp_path):
    d = spark.createDataFrame([("a.mp4", "xé")], "file string, body string")
    IO.write_files(d, f"{tmp_path}/out")
    assert [open(f"{x}/{f}", encoding="utf-8").read() for x, _, files in os.walk(tmp_path) for f in files] == ["xé\n"]
    with pytest.raises(FileExistsError):
        IO.write_files(d, f"{tmp_path}/out")
    assert IO.list_files(spark, f"{tmp_path}/out/part-*/a.mp4").count() == 1  # a pattern, as Spark's readers take
