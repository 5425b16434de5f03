"""The sink of whole files: all of a job's files, or none."""

import pytest

from strataforge.sources.files import FilesWriter, located, write_tree


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_write_tree(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.bin", bytes([i])) for i in range(20)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, body binary").repartition(5)
    root = tmp_path / "out"
    write_tree(df, str(root))
    want = {n: b for n, b in rows if b is not None}
    assert tree(root) == want and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="already"):
        write_tree(df, str(root))
    write_tree(df.limit(0), f"file://{root}", overwrite=True)
    assert tree(root) == {} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    """A task that fails after others have written: neither files nor staging stay, and what was there before stays."""
    rows = spark.createDataFrame([(f"f{i}" if i < 90 else "../out", bytearray(b"x")) for i in range(100)], "name string, body binary").repartition(8)
    root = tmp_path / "in" / "files"
    (tmp_path / "in").mkdir()
    with pytest.raises(Exception, match="leaves"):
        write_tree(rows, str(root))
    assert list((tmp_path / "in").iterdir()) == []
    write_tree(rows.where("name <> '../out'"), str(root))
    with pytest.raises(Exception, match="leaves"):
        write_tree(rows, str(root), overwrite=True)
    assert len(tree(root)) == 90 and [p.name for p in (tmp_path / "in").iterdir()] == ["files"]


def test_attempts_that_die_and_run_twice(tmp_path):
    """An attempt that dies in mid-write leaves no file in the tree; one that runs twice leaves one copy."""
    writer = FilesWriter(str(tmp_path / "t"), False)

    def dying():
        yield "a", b"1"
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    assert not list((tmp_path).rglob("own/*"))
    done = [writer.write(iter([("a", b"1"), ("b/c", b"2")])) for _ in range(2)]
    assert not (tmp_path / "t").exists()
    writer.commit(done)
    assert tree(tmp_path / "t") == {"a": b"1", "b/c": b"2"} and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_located():
    assert located("file:///a/b")[1] == located("file:/a/b")[1] == located("/a/b")[1] == "/a/b"
