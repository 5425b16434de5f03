"""One file from many tasks: a standard reader opens the archive, and lines come in order."""

import zipfile
import zlib

import pytest

from strataforge.sources import onefile


@pytest.mark.parametrize("deflate", [True, False])
def test_zip(spark, tmp_path, deflate):
    rows = [(f"d{i % 7}/é{i:03}.txt", (b"text %d " % i) * (i % 50)) for i in range(300)] + [("none", None), (None, b"x")]
    df = spark.createDataFrame(rows, "name string, body binary").repartition(6)
    path = tmp_path / "out" / "all.zip"
    placed = {r.name: r for r in onefile.write_zip(df, str(path), deflate).collect()}
    want = {n: b for n, b in rows if n is not None and b is not None}
    with zipfile.ZipFile(path) as archive:
        assert archive.testzip() is None and archive.namelist() == sorted(want, key=str.encode)
        assert {n: archive.read(n) for n in archive.namelist()} == want
        for info in archive.infolist():
            r = placed[info.filename]
            assert (info.header_offset, info.CRC, info.file_size, info.compress_size) == (r.at, r.crc, r.size, r.packed) and r.crc == zlib.crc32(want[info.filename])
    assert [p.name for p in path.parent.iterdir()] == ["all.zip"]
    onefile.write_zip(df.where("false"), str(path))
    assert zipfile.ZipFile(path).namelist() == []


def test_wide_records(tmp_path):
    """Beyond 4 GB and 65,535 members the wide fields hold the numbers."""
    name, body = b"far.txt", b"hello"
    at = (1 << 32) + 10
    path = tmp_path / "far.zip"
    local = onefile.local_record(name, zlib.crc32(body), 5, 5, 0) + body
    central = onefile.central_record(name, zlib.crc32(body), 5, 5, 0, at)
    with open(path, "wb") as file:
        file.seek(at)
        file.write(local + central + onefile.end_records(1, at + len(local), len(central)))
    with zipfile.ZipFile(path) as archive:
        assert archive.read("far.txt") == body
    path.unlink()
    assert onefile.end_records(70_000, 5, 6)[:4] == onefile.WIDE_END and onefile.end_records(7, 5, 6)[:4] == onefile.END


def test_lines_and_failures(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as k", "cast(concat(id, repeat('.', cast(id % 30 as int)), '\n') as binary) as body").repartition(7)
    path = tmp_path / "lines.txt"
    onefile.write_lines(df, ["k"], str(path), b"head\n")
    assert path.read_bytes() == b"head\n" + b"".join(b"%d%s\n" % (i, b"." * (i % 30)) for i in range(1000))
    with pytest.raises(Exception):
        onefile.write_at(df.selectExpr("if(k = 500, -1L, k) as at", "body"), str(path), 10)
    assert [p.name for p in tmp_path.iterdir()] == ["lines.txt"] and path.stat().st_size > 1000
    with pytest.raises(ValueError, match="mounted"):
        onefile.mounted("mock://x.zip")
