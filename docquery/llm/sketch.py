"""SetSketch registers of word-shingle sets, and the joint estimate of two sketches.

A register is a truncated minimum: of exponential values, one per element,
the least is kept as the integer K with BASE**-K just below it. Registers
of a union are the maxima of the registers (mergeable), and two sets agree in
a register with a probability that follows their Jaccard similarity
(locality-sensitive).
"""

from __future__ import annotations

import numpy as np

from docquery.llm.hashing import U, mix, windows, words

REGISTERS = 256
#: Base of the register scale, rate of the exponential values, largest register: as the scale of 16-bit registers.
STEP, RATE, TOP = 1.001, 20.0, 65535
_salts = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, (2, 1024), dtype=np.uint64).astype(np.uint32)
_salts[1] |= np.uint32(1)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` lower-cased words; fewer words are one shingle."""
    found = words(data, lower=True)[0]
    if not len(found):
        return found
    size = min(width, len(found))
    return np.unique(mix(windows(found, size) + U(size)))


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed longs."""
    both = np.array([elements.sum(dtype=np.uint64), mix(elements ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return tuple(both.view(np.int64).tolist())


def registers(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The m registers of a set of hashes, uint16; all 0 for the empty set."""
    if not len(elements):
        return np.zeros(m, np.uint16)
    x = (elements >> U(32)).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024, None] ^ _salts[0, :m]
        part *= _salts[1, :m]
        np.minimum(least, part.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(STEP)), 0, TOP).astype(np.uint16)


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given the sets' sizes.

    The registers that are greater, less and equal are a multinomial sample whose
    probabilities depend on the similarity; the likelihood is maximised on a grid.
    """
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / np.maximum(n_a + n_b, 1))[:, None]
    v = 1 - u
    bound = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(bound, 1)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)
    up, down = p(u - v * grid), p(v - u * grid)
    with np.errstate(divide="ignore"):
        score = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]
