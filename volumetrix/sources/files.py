"""Files of any store that Arrow opens, by plain path or URI."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def opened(path: str) -> pa.NativeFile:
    system, at = located(path)
    return system.open_input_file(at)


def parquet_files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The Parquet files of a folder, hidden ones left out, or the one file named."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return system, [at]
    found = system.get_file_info(fs.FileSelector(at))
    return system, sorted(f.path for f in found if f.is_file and f.extension == "parquet" and f.base_name[0] not in "._")
