"""Arrays as one small binary value: lengths, then each array's bytes, compressed where that helps."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)
#: Shorter arrays are stored as they are.
_SHORT = 64


def pack(*arrays: np.ndarray) -> bytes:
    head, body = [], []
    for a in arrays:
        raw = a.tobytes()
        if len(raw) >= 1 << 32:
            raise ValueError("an array of 4 GB or more does not fit")
        small = _CODEC.compress(raw, asbytes=True) if len(raw) > _SHORT else raw
        if len(small) >= len(raw):  # equal lengths mark bytes that are stored as they are
            small = raw
        head.append(struct.pack("<II", len(raw), len(small)))
        body.append(small)
    return b"".join(head + body)


def unpack(data, *types: str) -> list[np.ndarray]:
    """The arrays, given their types. data: bytes or a buffer."""
    view, out = memoryview(data), []
    at = 8 * len(types)
    for k, kind in enumerate(types):
        n, stored = struct.unpack_from("<II", view, 8 * k)
        part = view[at : at + stored]
        at += stored
        out.append(np.frombuffer(part if stored == n else _CODEC.decompress(part, n), kind))
    return out


_KINDS = ["u1", "<u2", "<u4", "<u8", "<i8", "<f8", "?"]


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(k for k, bits in zip(_KINDS, (8, 16, 32, 64), strict=False) if top < 1 << bits))


def pack_typed(*arrays: np.ndarray) -> bytes:
    """As pack, with the arrays' types."""
    return bytes([len(arrays), *(_KINDS.index(next(k for k in _KINDS if np.dtype(k) == a.dtype)) for a in arrays)]) + pack(*arrays)


def unpack_typed(data) -> list[np.ndarray]:
    view = memoryview(data)
    return unpack(view[1 + view[0] :], *(_KINDS[k] for k in view[1 : 1 + view[0]]))
