"""Random access to a file in any store that pyarrow opens, or to bytes in memory."""

from __future__ import annotations

import struct

import pyarrow.fs as pafs


class Source:
    """at(offset, n) reads up to n bytes; size is the file's."""

    def __init__(self, where: str | bytes):
        if isinstance(where, bytes):
            self._data, self._file, self.size = where, None, len(where)
        else:
            if "://" in where or where.startswith("file:"):
                found, path = pafs.FileSystem.from_uri(where if "://" in where else "file://" + where[len("file:") :])
            else:
                found, path = pafs.LocalFileSystem(), where
            self._data, self._file = b"", found.open_input_file(path)
            self.size = self._file.size()

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if offset < 0 or n <= 0:
            return b""
        if self._file is None:
            return self._data[offset : offset + n]
        self._file.seek(offset)
        return self._file.read(n)

    def unpack(self, form: str, offset: int) -> tuple | None:
        """Fields at an offset, or None beyond the end."""
        raw = self.at(offset, struct.calcsize(form))
        return struct.unpack(form, raw) if len(raw) == struct.calcsize(form) else None

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
