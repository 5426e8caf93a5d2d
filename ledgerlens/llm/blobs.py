"""Arrays as compact binary values, for rows that stand for many records."""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np


def freeze(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; bytes of equal significance lie together."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        body.append(pack(raw))
        head.append((name, a.dtype.str, len(body[-1]), len(raw)))
    text = json.dumps(head).encode()
    return len(text).to_bytes(4, "little") + text + b"".join(body)


def thaw(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    size = int.from_bytes(blob[:4], "little")
    at, out = 4 + size, {}
    for name, kind, length, raw in json.loads(blob[4:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(unpack(blob[at:at + length], max_output_size=raw), np.uint8) if raw else np.empty(0, np.uint8)
        out[name] = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
        at += length
    return out


def pieces(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of ``order``, which sorts by bucket, one bucket each."""
    if not len(order):
        return
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    for a, e in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
        yield int(b[a]), order[a:e]
