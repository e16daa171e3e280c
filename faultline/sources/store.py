"""Files on any store that tasks can reach: local folders, or what pyarrow knows by its URI."""

from __future__ import annotations

from urllib.parse import urlparse


def open_store(uri: str):
    """(file system, path without scheme)."""
    from pyarrow import fs
    scheme = urlparse(uri).scheme
    if not scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def files_under(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder and the folders in it, by path; none where nothing is."""
    from pyarrow import fs
    store, path = open_store(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    return sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)
