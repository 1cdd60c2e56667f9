"""Words of ASCII letters, digits and any other code points, as two operators count them, in batches of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z in lower case; every other ASCII byte that is no letter or digit becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """The maximal runs of letters, digits and non-ASCII bytes; null has none."""
    return text.translate(PLAIN).split() if text else []


def packed(lists: list[np.ndarray], kind: str) -> pa.Array:
    """Number lists as binary values, little-endian."""
    return pa.array([np.ascontiguousarray(x, dtype=kind).tobytes() for x in lists], pa.binary())


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each value has."""
    values = column.to_pylist()
    data = np.frombuffer(b"".join(values), dtype=kind)
    width = np.dtype(kind).itemsize
    return data, np.fromiter((len(v) // width for v in values), np.int64, len(values))
