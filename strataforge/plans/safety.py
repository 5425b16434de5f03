"""What must not be overwritten, and what stands where output would go. Paths may have a scheme."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyarrow import fs

from strataforge.sources.files import located

MARKER = "_STRATAFORGE"


def resolved(path: str) -> tuple[fs.FileSystem, PurePosixPath]:
    """The file system, and the path in it with links and dots followed where files are mounted."""
    system, place = located(path)
    return system, PurePosixPath(Path(place).resolve() if isinstance(system, fs.LocalFileSystem) else "/" + place.strip("/"))


def validate_output(out: str, inputs: list[str], marker: str = MARKER) -> PurePosixPath:
    """The resolved folder; ValueError for a root or bucket, the home folder, an input, its parents or what lies in it, a file, or a filled folder that no earlier run marked."""
    system, path = resolved(out)
    if len(path.parts) < (2 if isinstance(system, (fs.LocalFileSystem, fs.HadoopFileSystem)) else 3):
        raise ValueError("refusing to write to a file system's root")
    if isinstance(system, fs.LocalFileSystem) and path == PurePosixPath(Path.home().resolve()):
        raise ValueError("refusing to write to the home folder")
    for source in inputs:
        other, source_path = resolved(source)
        if other == system and (path == source_path or path in source_path.parents or source_path in path.parents):
            raise ValueError(f"refusing to write to {path}: it overlaps the input {source_path}")
    if system.get_file_info(located(out)[1]).is_file:
        raise ValueError(f"{path} is a file")
    if (found := existing(out, marker)) and found[0]:
        raise ValueError(f"{path} holds {found[0]} entries that no earlier run wrote: {', '.join(found[1])}")
    return path


def existing(out: str, marker: str = MARKER, most: int = 8) -> tuple[int, list[str]] | None:
    """(number, first names whatever their case, folders with /) of what is there; None if missing, empty or marked."""
    system, place = located(out)
    rows = system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if not system.get_file_info(place).is_file else []
    if not rows or any(r.base_name == marker for r in rows):
        return None
    names = sorted((r.base_name + "/" * (r.type == fs.FileType.Directory) for r in rows), key=str.lower)
    return len(rows), names[:most]


def mark(out: str, marker: str = MARKER) -> None:
    """Leaves the mark of a run in its folder."""
    system, place = located(out)
    with system.open_output_stream(f"{place}/{marker}") as file:
        file.write(b"written by strataforge\n")
