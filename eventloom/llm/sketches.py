"""SetSketch registers of sets of 64-bit hashes.

Every element is the source of a Poisson process that throws points onto
``REGISTERS`` registers; a register keeps the smallest point of any element,
as an integer on an exponential scale with base ``SCALE``, truncated to 16 bits.
The registers of a union are the larger ones of its parts, and two sets agree
on a register with about the probability of their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from eventloom.llm.words import GOLDEN, mix

REGISTERS = 128
#: Fine enough that unrelated sets of equal size agree on one register in 4,000.
SCALE = 1.001
#: The scale's zero, so that sets from one element to 1e24 stay within 16 bits.
SHIFT = 5000.0
WIDTH = 2
#: Bytes of parities that are compared at once.
COMPARED_BYTES = 4 << 20


def sketch(elements: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of registers for each set ``elements[first[i]:first[i + 1]]``; an empty set has zeros."""
    sizes = np.diff(first)
    out = np.zeros((len(sizes), registers), np.uint16)
    open_sets, reach = np.flatnonzero(sizes), 3.0
    while len(open_sets):
        lowest = _lowest(elements, first, open_sets, (np.log(registers) + reach) / sizes[open_sets], registers)
        full = np.isfinite(lowest).all(axis=1)
        levels = np.floor(SHIFT - np.log(lowest[full]) / np.log(SCALE))
        out[open_sets[full]] = np.clip(levels, 0, 65535).astype(np.uint16)
        open_sets, reach = open_sets[~full], 2 * reach + 3
    return out


def _lowest(elements: np.ndarray, first: np.ndarray, chosen: np.ndarray, limit: np.ndarray, registers: int) -> np.ndarray:
    """The smallest point in each register among the points up to a set's limit."""
    sizes = np.diff(first)[chosen]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    starts = np.cumsum(sizes) - sizes
    value = elements[np.arange(len(owner)) - np.repeat(starts - first[:-1][chosen], sizes)]
    at, reach = np.zeros(len(owner)), limit[owner]
    out = np.full(len(chosen) * registers, np.inf)
    while len(owner):
        value = mix(value + GOLDEN)
        at = at - np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
        alive = at <= reach
        value, at, owner, reach = value[alive], at[alive], owner[alive], reach[alive]
        np.minimum.at(out, owner * registers + (value & np.uint64(registers - 1)).astype(np.int64), at)
    return out.reshape(-1, registers)


def parities(elements: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set, whether an odd number of its elements falls on each place, as bits.

    A set has four to eight places an element, and a power of two, so that the parities of a larger
    set can be folded to the places of a smaller one.
    """
    sizes = np.diff(first)
    words = np.uint64(1) << np.ceil(np.log2(np.maximum(sizes / 16, 1))).astype(np.uint64)
    ends = np.cumsum(words.astype(np.int64))
    begins = ends - words.astype(np.int64)
    word = (elements >> np.uint64(6)) & np.repeat(words - np.uint64(1), sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    np.bitwise_xor.at(out, np.repeat(begins, sizes) + word.astype(np.int64), np.uint64(1) << (elements & np.uint64(63)))
    return [out[lo:hi].tobytes() for lo, hi in zip(begins, ends, strict=True)]


def differing(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At how many places the parities ``a[i]`` and ``b[j]`` of each pair differ.

    Elements in both sets cancel out and every other one turns one place, so there are never more
    of them than elements in one of the two sets alone.
    """
    width = np.minimum(np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j])
    out = np.zeros(len(i), np.int64)
    for each in np.unique(width):
        chosen = np.flatnonzero(width == each)
        step = max(1, COMPARED_BYTES // int(each))
        for at in range(0, len(chosen), step):
            pick = chosen[at : at + step]
            out[pick] = np.bitwise_count(_folded(a, i[pick], each) ^ _folded(b, j[pick], each)).sum(axis=1)
    return out


def _folded(rows: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    """The parities ``rows[at]`` on the places that ``width`` bytes have."""
    used, where = np.unique(at, return_inverse=True)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(rows[k], np.uint64).reshape(-1, width // 8), axis=0) for k in used])[where]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _above(share: np.ndarray) -> np.ndarray:
    """How likely the set that owns this share of the union alone is strictly ahead on a register."""
    return -np.log1p(-share * (SCALE - 1) / SCALE) / np.log(SCALE)


def plausible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, margin: float) -> np.ndarray:
    """Pairs whose similarity may reach the threshold.

    The sizes are known, so the joint likelihood of the registers depends on the
    similarity alone. A pair goes only if the best similarity at or above the
    threshold is less likely than the best one overall by ``margin`` in log
    likelihood, if its sizes rule the threshold out, or if its equal registers
    are seven standard deviations below what the threshold lets expect.
    """
    n_a, n_b = size_a.astype(float), size_b.astype(float)
    most = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    out = (most >= similarity) & (n_a > 0) & (n_b > 0)
    pick = np.flatnonzero(out)
    least = REGISTERS * similarity - 7 * np.sqrt(REGISTERS * similarity * (1 - similarity))
    near = (a[pick] == b[pick]).sum(axis=1) >= least
    out[pick[~near]], pick = False, pick[near]
    if not len(pick):
        return out
    ahead, behind = (a[pick] > b[pick]).sum(axis=1), (a[pick] < b[pick]).sum(axis=1)
    u, v, most = n_a[pick] / (n_a[pick] + n_b[pick]), n_b[pick] / (n_a[pick] + n_b[pick]), most[pick]

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _above(np.maximum(u - v * j, 1e-12)), _above(np.maximum(v - u * j, 1e-12))
        return ahead * np.log(p) + behind * np.log(q) + (REGISTERS - ahead - behind) * np.log(np.maximum(1 - p - q, 1e-12))

    best, reached = np.full(len(pick), -np.inf), np.full(len(pick), -np.inf)
    for t in np.linspace(0, 1, 17):
        best = np.maximum(best, likelihood(t * most))
        reached = np.maximum(reached, likelihood(similarity + t * (most - similarity)))
    out[pick] = reached >= np.maximum(best, reached) - margin
    return out
