"""Binary files of any store that pyarrow knows, for readers that run in tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str):
    """A file that can be read at any place."""
    system, inner = (fs.LocalFileSystem(), path.removeprefix("file://")) if "://" not in path or path.startswith("file://") else fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)
