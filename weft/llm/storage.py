"""Files in a shared folder, named by URI, from any Python worker."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a local one."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """The bytes of a file, or ``length`` of them; a negative offset counts from the end."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        start = max(0, size + offset) if offset < 0 else offset
        return file.read_at(size - start if length is None else length, start)
