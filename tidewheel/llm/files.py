"""Files that tasks write to and read from the shared folder, by URI."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it; a plain path is a local one."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(parts.path if parts.scheme else uri)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Sink:
    """A file under a name of its own per attempt, moved to its final name when complete.

    An attempt that dies leaves nothing under the final name; of two attempts that both
    finish, the later replaces the other's equal file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        folder = self.path.rpartition("/")[0]
        self.fs.create_dir(folder, recursive=True)
        self.draft = f"{folder}/.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)


def open_input(uri: str):
    where, path = filesystem(uri)
    return where.open_input_file(path)


def read_bytes(uri: str) -> bytes:
    with open_input(uri) as source:
        return source.read()
