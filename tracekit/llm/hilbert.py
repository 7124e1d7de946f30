"""Position of points on a Hilbert curve, for whole columns of points (after Skilling's transform of axes, 2004)."""

from __future__ import annotations

import numpy as np

from tracekit.llm.common import ship

ship(__name__)


def position(cells: np.ndarray, bits: int) -> np.ndarray:
    """Big-endian bytes (rows x bytes) of the curve position of rows of cell numbers below 2**bits."""
    x = cells.T.astype(np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for axis in x:
            here = (axis & np.uint32(q)) != 0
            swap = np.where(here, np.uint32(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(here, low, np.uint32(0))
            x[0] ^= swap
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
