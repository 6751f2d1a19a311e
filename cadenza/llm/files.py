"""Files in the shared folder, from driver or executors, by any scheme that Arrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class created:  # noqa: N801
    """A file under a name of its own, streamed and moved into place at the end, so that a repeated task never meets a
    half-written one. Without open() there is no file."""

    def __init__(self, folder: str, name: str):
        self.system, self.base = locate(folder)
        self.own = f"{name}-{uuid.uuid4().hex}"
        self.path, self.stream = f"{folder}/{self.own}", None

    def open(self):
        self.system.create_dir(self.base, recursive=True)
        self.stream = self.system.open_output_stream(f"{self.base}/{self.own}.part", compression=None)
        return self.stream

    def __enter__(self):
        return self

    def __exit__(self, kind, *_) -> None:
        if self.stream is not None:
            self.stream.close()
            if kind is None:
                self.system.move(f"{self.base}/{self.own}.part", f"{self.base}/{self.own}")


def open_input(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
