"""Archives are read as they land, each once."""

import builder as B

from strataforge.streaming.landing import landing_entries


def test_landing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def settle():
        stream = landing_entries(spark, str(folder), exts=["TILE"])
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.display_name for r in spark.read.parquet(out).collect())

    (folder / "a.bin").write_bytes(B.archive([("IMAG", [("x", b"1")]), ("TILE", [("t1", b"22"), ("t2", b"")])]))
    assert settle() == ["t1", "t2"]
    (folder / "b.bin").write_bytes(B.archive([("TILE", [("t3", b"3")])]))
    assert settle() == ["t1", "t2", "t3"]
