"""Arrays as one compressed value of a table."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa


def pack(*values) -> bytes:
    raw = pickle.dumps(values, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))) if values.min(initial=0) >= 0 else np.int64)
