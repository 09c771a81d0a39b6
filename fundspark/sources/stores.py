"""Files by byte position, from tasks: local ones and those of any store that Arrow reads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow.fs as fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local path or a URI, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path, re.IGNORECASE):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_below(path: str, suffix: str) -> Iterator[fs.FileInfo]:
    """The files below a folder that end in ``suffix``, by path; hidden ones are left out.

    ``path`` may also be one file. A missing folder has none.
    """
    store, root = located(path)
    here = store.get_file_info(root)
    if here.type == fs.FileType.File:
        found = [here]
    else:
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    for info in sorted(found, key=lambda i: i.path):
        if info.type == fs.FileType.File and info.path.endswith(suffix) and info.base_name[0] not in "._":
            yield info
