"""Vectorised 64-bit ranks of byte and word sequences (numpy, inside tasks).

A rank is a hash without linear structure: every step multiplies and mixes
what came before, so that rearranged or periodic sequences (which fool
polynomials modulo 2**64) get ranks as unrelated as any others. The rank of 2h
symbols comes from the ranks of two neighbouring runs of h (prefix doubling),
so a fixed length costs a logarithmic number of array operations. What decides
about rows is compared by two ranks of 64 bits or by the symbols themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
ODD, LENGTHS = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Bytes that one load covers; bytes of a word beyond which it is hashed by a digest.
LOAD, LONG = 8, 64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Whatever is neither an ASCII letter or digit nor part of a longer UTF-8 character.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a load.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of two parts in this order, from their (mixed) ranks."""
    x = left * ODD
    x += right
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def loads(a: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number, with zeros after the end."""
    return np.ndarray((len(a),), "<u8", np.concatenate((a, np.zeros(LOAD, np.uint8))), 0, (1,))


def byte_ranks(data: bytes) -> np.ndarray:
    """Ranks of all runs of LOAD bytes."""
    a = np.frombuffer(data, np.uint8)
    return mix(loads(a)[: len(a) - LOAD + 1]) if len(a) >= LOAD else np.zeros(0, np.uint64)


def hashed(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the byte strings a[start:end]."""
    held, sizes = loads(a), ends - starts
    out = mix((held[starts] & FIRST[np.minimum(sizes, LOAD)]) ^ mix(sizes.astype(np.uint64) * LENGTHS)) if len(starts) else np.zeros(0, np.uint64)
    at, step = np.flatnonzero(sizes > LOAD), LOAD
    while len(at) and step < LONG:
        out[at] = mix(out[at] * ODD + (held[starts[at] + step] & FIRST[np.minimum(sizes[at] - step, LOAD)]))
        step += LOAD
        at = at[sizes[at] > step]
    for i in at.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(ranks: np.ndarray, length: int, unit: int = 1) -> np.ndarray:
    """Ranks of every run of `length` symbols, by doubling, from those of every run of `unit`; empty if there are fewer."""
    n = len(ranks) + unit - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    while 2 * unit <= length:
        ranks = joined(ranks[:-unit], ranks[unit:])
        unit *= 2
    return ranks if unit == length else joined(ranks[:n], ranks[length - unit : length - unit + n])


def spans(ranks: np.ndarray, unit: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the runs of symbols start:end (of `unit` at least), from those of every run of `unit`."""
    sizes = ends - starts
    out = joined(ranks[starts], mix(sizes.astype(np.uint64) * LENGTHS))
    for step in range(unit, int(sizes.max(initial=0)) - unit, unit):
        out = joined(out, ranks[np.minimum(starts + step, ends - unit)])
    return joined(out, ranks[ends - unit])


def words(data: bytes, lower: bool = False, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, start and end of every word of UTF-8 bytes; words are runs of bytes that are not `between`."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], (~between[a]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hashed(LOWER[a] if lower else a, starts, ends), starts, ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values."""
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def slices(sizes, limit: int):
    """Ranges of rows whose sizes sum to about `limit`, for bounded work in a batch."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
