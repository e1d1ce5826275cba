"""Seekable Zstandard files: independent frames, an index in a skippable frame, and a trailing seek table.

The layout is that of the public Zstandard seekable format: data frames; a skippable frame that
holds, for each frame, its compressed and decompressed size and the low 32 bits of the XXH64 of its
content; and a footer that lets a reader find the table from the end. The index is a skippable frame
of its own before the seek table, counted there as a frame of decompressed size 0, so a plain zstd
decoder reads the data and skips the rest.

Files are reached through Arrow file systems by URI, so the folder may be a mounted one or a store.
A file is written under a temporary name and moved when complete: a task that is lost and run again
leaves the same file, and a reader never sees half of one.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs
import xxhash
import zstandard

SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return fs, path


class Writer:
    """Append frames, then ``close`` with the bytes of the index."""

    def __init__(self, uri: str, level: int = 3):
        self.fs, self.path = _open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []

    def frame(self, data: bytes) -> int:
        """Write one frame; returns its number."""
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def close(self, index: bytes) -> None:
        packed = self.zstd.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self.entries.append((len(packed) + 8, 0, 0))
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


class Reader:
    """Random access to the frames of one file; only the frames asked for are read and decompressed."""

    def __init__(self, uri: str):
        fs, path = _open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(n * _ENTRY.size, size - _FOOTER.size - n * _ENTRY.size)
        self.entries = [_ENTRY.unpack_from(table, i * _ENTRY.size) for i in range(n)]
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def index(self) -> bytes:
        data = self.file.read_at(self.entries[-1][0], self.starts[-2])
        return self.zstd.decompress(data[8:])

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        data = self.zstd.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def close(self) -> None:
        self.file.close()
