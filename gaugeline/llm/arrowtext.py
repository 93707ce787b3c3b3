"""Helpers for Arrow batches of texts: bytes of each row, byte tables, schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = [c for c in range(256) if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128)]
#: A-Z to a-z.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z to a-z and everything that ends a word of letters and digits to a blank.
LETTER_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _WORD else c for c in range(256))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each row; empty for null. Only one row is copied at a time."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for value in chunk.cast(pa.large_binary()):
            yield value.as_py() or b""


def id_list(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
