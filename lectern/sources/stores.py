"""File systems as tasks reach them: mounted folders, and any scheme that pyarrow knows (hdfs, s3, gs, abfs).

Reads go in chunks and end at a ceiling. A write is whole or not there: its bytes lie
under another name, on the disk, before it takes its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs

CHUNK = 1 << 16
#: How often a move that lost a race is tried, and the first wait in seconds, doubled each time.
TRIES, WAIT = 6, 0.002
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(.*)", re.S)
KNOWN = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def scheme_of(folder: str) -> str:
    """The scheme of a path; a path without one is that of a mounted folder."""
    m = _SCHEME.fullmatch(folder)
    return m[1].lower() if m and len(m[1]) > 1 else "file"


def reachable(folder: str) -> bool:
    return scheme_of(folder) in KNOWN


@dataclass(frozen=True)
class Store:
    fs: pafs.FileSystem
    root: str
    local: bool

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str | None = None) -> list[tuple[str, int]]:
        """(name, length) of the files of a folder, not of those below it, in name order; none where there is no folder."""
        found = self.fs.get_file_info(pafs.FileSelector(folder or self.root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.type == pafs.FileType.File)

    def each(self, folder: str | None = None, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, int]]:
        """(name, length) of a folder's files whose names are wanted, in any order; a mounted folder's are not held in memory."""
        if not self.local:
            yield from ((name, length) for name, length in self.names(folder) if wanted(name))
            return
        with os.scandir(folder or self.root) as found:
            for f in found:
                if wanted(f.name) and f.is_file():
                    yield f.name, f.stat().st_size

    def folders(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.Directory)

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def read(self, path: str, most: int) -> bytes | None:
        """All of a file, or null once it turns out to be longer than ``most``, whatever its listing said; memory is bounded by ``most`` and a chunk."""
        parts, size = [], 0
        with self.fs.open_input_stream(path) as f:
            while chunk := f.read(min(CHUNK, most + 1 - size)):
                size += len(chunk)
                if size > most:
                    return None
                parts.append(chunk)
        return b"".join(parts)

    def sha256(self, path: str) -> str:
        """Of a file's bytes, read in chunks."""
        told = hashlib.sha256()
        with self.fs.open_input_stream(path) as f:
            while chunk := f.read(CHUNK):
                told.update(chunk)
        return told.hexdigest()

    def write(self, path: str, data: bytes) -> None:
        """A new file, forced to the disk where it is a mounted one."""
        self.fs.create_dir(os.path.dirname(path))
        if self.local:
            with open(path, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        else:
            with self.fs.open_output_stream(path) as f:
                f.write(data)

    def move(self, old: str, new: str, exclusive: bool = False) -> bool:
        """One step by which ``new`` is all of ``old``. With exclusive, false if ``new`` is there already.

        On a mounted folder that is decided by the file system (a hard link), elsewhere
        by looking first.
        """
        if exclusive and self.local:
            try:
                os.link(old, new)
            except FileExistsError:
                return False
            os.unlink(old)
            return True
        if exclusive and self.exists(new):
            return False
        for k in range(TRIES):
            try:
                self.fs.move(old, new)
                break
            except PermissionError:  # a reader may hold the old file for a moment
                if k == TRIES - 1:
                    raise
                time.sleep(WAIT * 2**k)
        return True

    def remove(self, path: str) -> None:
        self.fs.delete_file(path)

    def drop(self, folder: str) -> None:
        if self.exists(folder):
            self.fs.delete_dir(folder)


def open_store(folder: str) -> Store:
    """The store of a folder, by its path."""
    m = _SCHEME.fullmatch(folder)
    scheme = scheme_of(folder)
    if scheme == "file":
        path = m[3] if m and len(m[1]) > 1 else folder
        return Store(pafs.LocalFileSystem(), os.path.abspath(path), True)
    if scheme not in KNOWN:
        raise ValueError(f"tasks cannot reach {scheme}: files themselves; known are {', '.join(KNOWN)}")
    scheme = {"s3a": "s3", "gcs": "gs"}.get(scheme, scheme)
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{m[2] or ''}")
    return Store(fs, (base.rstrip("/") + m[3]).rstrip("/"), False)


def unique() -> str:
    return uuid.uuid4().hex
