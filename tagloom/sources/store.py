"""Files of any store that pyarrow knows (local paths, file, hdfs, s3 and gs URIs), opened for reading at places."""

from __future__ import annotations

import io
import posixpath
from typing import BinaryIO

#: Bytes that a reader asks for at once when it scans, and when it looks something up.
SCAN, SEEK = 1 << 20, 1 << 16


def of(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def opened(path: str, buffer: int = SCAN) -> BinaryIO:
    """A file for reading and seeking. A local one that isn't there is a FileNotFoundError in any case."""
    system, name = of(path)
    return io.BufferedReader(system.open_input_file(name), buffer)


def size(path: str) -> int:
    system, name = of(path)
    found = system.get_file_info(name)
    if not found.is_file:
        raise FileNotFoundError(path)
    return found.size


def listed(path: str, ending: str) -> list[str]:
    """A file, the files of a folder with an ending, or those that a pattern in the last component names; sorted, without hidden ones."""
    from fnmatch import fnmatchcase

    from pyarrow import fs

    system, name = of(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    if info.is_file:
        return [path]
    folder, pattern = (name.rstrip("/"), f"*{ending}") if info.type == fs.FileType.Directory else posixpath.split(name)
    found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    names = [(x.base_name, x.path) for x in found if x.is_file and fnmatchcase(x.base_name, pattern) and not x.base_name.startswith((".", "_"))]
    return [head + p for _, p in sorted(names)]
