"""Numpy arrays in flat files that all workers of a machine map into memory, so that it holds them once."""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
import pyarrow.fs

_ALIGN = 64


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def save(path: str, arrays: dict[str, np.ndarray]) -> int:
    """Writes the arrays and returns the file's bytes. The file appears as a whole; a task that runs twice replaces it."""
    fs, inner = opened(path)
    at, heads = 0, {}
    for name, x in arrays.items():
        heads[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // _ALIGN) * _ALIGN
    head = json.dumps(heads).encode()
    head = len(head).to_bytes(8, "little") + head
    head += b"\0" * (-len(head) % _ALIGN)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    draft = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(head)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).view(np.uint8).data)
            out.write(b"\0" * (-x.nbytes % _ALIGN))
    fs.move(draft, inner)
    return len(head) + at


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the folder is mounted, else read into the worker's own memory."""
    fs, inner = opened(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with open(inner, "rb") as f:
            data: object = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_file(inner) as f:
            data = f.read_buffer()
    size = int.from_bytes(memoryview(data)[:8], "little")
    heads = json.loads(bytes(memoryview(data)[8 : 8 + size]))
    base = -(-(8 + size) // _ALIGN) * _ALIGN
    return {name: np.frombuffer(data, kind, n, base + at) for name, (kind, n, at) in heads.items()}
