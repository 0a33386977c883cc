"""ZIP archives of many tasks, and folders."""

from __future__ import annotations

import io
import zipfile

import pytest

from weftline.operators import validate
from weftline.sources import archives, zip_files
from weftline.sources.tables import shared_folder

FILES = "archive string, path string, bytes binary"


def opened(spark, folder, archive):
    with zipfile.ZipFile(zip_files.segments(spark, folder, archive)) as z:
        assert z.testzip() is None
        return {i.filename: z.read(i) for i in z.infolist()}


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_segments_are_archives(spark, many_tasks):
    """Two archives over many tasks; zipfile takes the segments for one file, and so it does when they are put together."""
    rows = [("one", f"d/é{i}.html", f"text {i} ".encode() * (i % 50)) for i in range(300)] + [("two", "only", b"\x00" * 100_000), ("two", "none", None)]
    folder = shared_folder(spark)
    manifest = zip_files.write_zip(spark.createDataFrame(rows, FILES).repartition(5), folder)
    assert manifest.where("archive = 'one'").count() > 4
    assert opened(spark, folder, "one") == {p: b for a, p, b in rows if a == "one"}
    assert opened(spark, folder, "two") == {"only": b"\x00" * 100_000, "none": b""}
    whole = zip_files.segments(spark, folder, "one").read()
    parts = sorted((r["at"], r["size"]) for r in manifest.where("archive = 'one'").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))  # no gap
    assert len(zipfile.ZipFile(io.BytesIO(whole)).namelist()) == 300
    for share in (1000, 1 << 20):
        got = zip_files.members(spark, folder, share)
        assert sorted((r["archive"], r["path"], bytes(r["bytes"])) for r in got.collect()) == sorted((a, p, b or b"") for a, p, b in rows)
    assert got.rdd.getNumPartitions() == 2
    assert zip_files.members(spark, folder, 1000).rdd.getNumPartitions() > 10


def test_no_files(spark):
    folder = shared_folder(spark)
    assert zip_files.write_zip(spark.createDataFrame([], FILES), folder).count() == 0


def test_archives_beyond_32_bits():
    """Entries that lie beyond 4 GB, and more of them than 16 bits count, as zipfile reads them."""
    at, name = 5 << 30, b"far"
    member = zip_files._member(name, 0, 0, 2) + b"\x03\x00"
    far = zip_files._entry(name, 0, 0, 2, at)
    end = zip_files._end(1, len(far), at + len(member))

    class Sparse(io.RawIOBase):
        size, place = at + len(member) + len(far) + len(end), 0
        seekable = readable = lambda self: True
        tell = lambda self: self.place

        def seek(self, offset, whence=0):
            self.place = offset + (0, self.place, self.size)[whence]
            return self.place

        def readinto(self, buffer):
            tail = (member + far + end)[self.place - at :] if self.place >= at else b"\x00" * len(buffer)
            n = min(len(buffer), len(tail))
            buffer[:n] = tail[:n]
            self.place += n
            return n

    with zipfile.ZipFile(io.BufferedReader(Sparse())) as z:
        (info,) = z.infolist()
        assert (info.filename, info.header_offset) == ("far", at)
        assert z.read("far") == b""
    many = 70_000
    entries = b"".join(zip_files._entry(b"%d" % i, 0, 0, 2, 0) for i in range(many))
    assert len(zipfile.ZipFile(io.BytesIO(entries + zip_files._end(many, len(entries), 0))).infolist()) == many


def test_zip_files_and_folders(spark, tmp_path):
    """Files that others wrote; of one large archive each task reads its range."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "in" / "sub" / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in (("index.html", "<p>é"), ("a/b.png", b"\x00\x01"), ("../out", "x"), ("dir/", "")):
            z.writestr(path, content)
    with zipfile.ZipFile(tmp_path / "in" / "many.ZIP", "w") as z:
        for i in range(200):
            z.writestr(f"f{i}.txt", f"{i}" * 100)
    got = archives.read_zip(spark, str(tmp_path / "in"))
    one = {r["path"]: (bytes(r["bytes"]), r["mime_type"], r["text"]) for r in got.where("archive like '%one.zip'").collect()}
    assert one == {"index.html": ("<p>é".encode(), "text/html", "<p>é"), "a/b.png": (b"\x00\x01", "image/png", None)}
    many = zip_files.members(spark, str(tmp_path / "in" / "many.ZIP"), 4000)
    assert many.rdd.getNumPartitions() > 5
    assert {r["path"]: bytes(r["bytes"]) for r in many.collect()} == {f"f{i}.txt": b"%d" % i * 100 if i > 9 else b"%d" % i * 100 for i in range(200)}
    assert archives.read_zip(spark, f"file://{tmp_path}/in/sub/one.zip").count() == 2


@pytest.mark.parametrize("form", ["{0}/site", "file://{0}/site/", "file:{0}/site"])
def test_folders_below_folders_of_their_name(spark, tmp_path, form):
    for path in ("x.html", "site/x.html", "sub/site/y.css"):
        (tmp_path / "site" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / path).write_text("a{}")
    got = archives.read_folder(spark, form.format(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["site/x.html", "sub/site/y.css", "x.html"]


def test_archives_are_validated_apart(spark):
    """Two archives that each load a script once are no archive that loads it twice."""
    files = spark.createDataFrame([("a", "i.html", '<script src="a.js"></script>'), ("b", "i.html", '<script src="a.js"></script>'), ("c", "i.html", '<script src="a.js"></script><script src="a.js#2"></script>')], "archive string, path string, text string")
    assert [tuple(r) for r in validate.scan_html(files).select("archive", "code").collect()] == [("c", "duplicate-executable-reference")]
    required = spark.createDataFrame([("a", "i.html", True), ("b", "x.html", True), ("c", "y.html", False)], "archive string, path string, critical boolean")
    missing = validate.missing_files(required, files)
    assert sorted((r["archive"], r["path"], r["severity"]) for r in missing.collect()) == [("b", "x.html", "error"), ("c", "y.html", "warning")]
    verdicts = validate.finalize(missing.unionByName(validate.scan_html(files)), archives=files)
    assert sorted((r["archive"], r["status"], r["issue_count"]) for r in verdicts.collect()) == [("a", "ready", 0), ("b", "failed", 1), ("c", "partial", 2)]
