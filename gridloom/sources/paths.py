"""Files by path or URI (``file://``, ``hdfs://``, ``s3://``, ..), for the driver and the tasks alike, through Arrow's file systems."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs

from ..meta import TensorError


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def joined(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *(n.strip("/") for n in names)])


def info(path: str) -> fs.FileInfo:
    files, inner = located(path)
    return files.get_file_info(inner)


def size(path: str) -> int:
    found = info(path)
    if found.type != fs.FileType.File:
        raise TensorError(f"{path} does not exist")
    return found.size


def opened(path: str) -> BinaryIO:
    """The file for reading anywhere in it; each process keeps it open while it is the same file."""
    kept = sys.__dict__.setdefault("_gridloom_files", {})
    now = info(path)
    if now.type != fs.FileType.File:
        raise TensorError(f"{path} does not exist")
    key = (path, now.mtime_ns, now.size)
    if key not in kept:
        files, inner = located(path)
        kept[key] = files.open_input_file(inner)
    return kept[key]


def ranges(path: str) -> Callable[[int, int], bytes]:
    """A function that gives ``n`` bytes of a file from ``at`` on, fewer at its end."""

    def read(at: int, n: int) -> bytes:
        f = opened(path)
        f.seek(at)
        return f.read(n)

    return read


def whole(path: str) -> bytes | None:
    """The file's bytes; None if there is none."""
    files, inner = located(path)
    if files.get_file_info(inner).type != fs.FileType.File:
        return None
    with files.open_input_stream(inner) as f:
        return f.read()


def names(folder: str, recursive: bool = False) -> list[str]:
    """Files in a folder, by their names from there, in order."""
    files, inner = located(folder)
    found = files.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return sorted(x.path[len(inner) :].lstrip("/") for x in found if x.type == fs.FileType.File)


def put(path: str, data: bytes) -> None:
    """Writes a file as a whole: a task that runs again replaces it."""
    files, inner = located(path)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, inner)
