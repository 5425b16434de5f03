"""The command line on synthetic archives."""

import zipfile

import pytest
from test_extraction import NAMES, files

from strataforge.plans import cli


def test_command_line(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    for name, body in files().items():
        (data / name).write_bytes(body)
    (tmp_path / "names.csv").write_text("set_id,name\n" + "".join(f"{i},{n}\n" for i, n in NAMES))
    out = tmp_path / "out"
    args = ["--archive", f"main:main={data}/main.bin", "--archive", f"picture:pict={data}/pict.bin", "--names", str(tmp_path / "names.csv"), "--out", str(out), "--files", "--zip", "--one-manifest", "--limit", "2"]
    assert cli.main(args, spark) == {"images": 8, "records": 2}
    assert {p.name for p in out.iterdir()} >= {"manifest", "images", "previews", "_STRATAFORGE"}
    images = {r.png: bytes(r.image) for r in spark.read.parquet(f"{out}/images").collect()}
    assert {str(p.relative_to(out / "files")): p.read_bytes() for p in (out / "files").rglob("*") if p.is_file()} == images and len(images) == 8
    with zipfile.ZipFile(out / "images.zip") as archive:
        assert archive.testzip() is None and {n: archive.read(n) for n in archive.namelist()} == images
    parts = b"".join(p.read_bytes().split(b"\r\n", 1)[1] for p in sorted((out / "manifest").glob("part-*")))
    assert (out / "manifest.csv").read_bytes().split(b"\r\n", 1)[1] == parts and parts.count(b"\r\n") == 8
    (out / "files" / "old.png").write_text("")
    cli.main([*args, "--yes"], spark)
    assert {str(p.relative_to(out / "files")) for p in (out / "files").rglob("*") if p.is_file()} == set(images)
    with pytest.raises(ValueError):
        cli.main([*args[:-7], "--out", str(data)], spark)
    with pytest.raises(SystemExit):
        cli.main([*args[:-1], "0"], spark)
    sizes = {f: [f"{data}/{n}" for n in ns] for f, ns in {"main": ["main.bin"], "picture": ["pict.bin"]}.items()}
    length = {n: (data / n).stat().st_size for n in ("main.bin", "pict.bin")}
    assert cli.estimate(spark, sizes, "relevant-raw") == int(length["main.bin"] * 0.55 + length["pict.bin"] * 0.10)
    with pytest.raises(SystemExit, match="gone.bin"):
        cli.main(["--archive", f"main:main={data}/gone.bin", *args[2:]], spark)
    assert cli.present(spark, [("main", "main", f"{data}/main.bin"), ("picture", "p", f"{data}/gone.bin")]) == [("main", "main", f"{data}/main.bin")]
