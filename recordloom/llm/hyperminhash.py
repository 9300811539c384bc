"""HyperMinHash sketches of word shingle sets.

Each shingle has one 64-bit hash. Its first bits name one of REGISTERS buckets;
of the remaining bits a bucket keeps the rarest pattern met: the count of leading
zeros (capped at MOST_ZEROS) and, behind the first one, MANTISSA further bits.
Both are stored in 16 bits such that a smaller number is a rarer pattern; an
empty bucket holds EMPTY. Equal registers therefore mean, but for collisions of
zeros and mantissa, that both sets have the same smallest hash in the bucket.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
REGISTERS = 256
BITS = 8
MANTISSA = 10
MOST_ZEROS = 62
EMPTY = 0xFFFF
ROWS = 4  # registers in a band
BANDS = 32  # of sets beyond SHORT, a pair at 0.75 shares none with a chance of 5e-6
SHORT = 32  # shingles of a set that fills too few registers for independent bands
DEVIATIONS = 4.5  # an estimate this far below the threshold rules a pair out
SLACK = 0.01  # for what the correction of collisions leaves
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, A-Z lower."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def shingles(self, text: str) -> np.ndarray:
        """The sorted distinct 64-bit hashes of a text's shingles: of SHINGLE
        words each, of all words where there are fewer, of none without words."""
        found = words(text)
        known = self.known
        for word in set(found):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(known) > self.most:
            self.known = {}
        width = min(SHINGLE, len(found))
        if not width:
            return hashes
        size = len(hashes) - width + 1
        total = np.full(size, width, np.uint64)
        for at in range(width):
            total = (total + hashes[at : at + size]) * MULTIPLIER
            total ^= total >> np.uint64(29)
        return np.unique(mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    registers = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(hashes):
        return registers
    places = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    rest = hashes << np.uint64(BITS)
    # Leading zeros from the exponent of the value as a double: exact here, as
    # the value is cut to 52 bits first.
    top = rest >> np.uint64(12)
    _, exponent = np.frexp(top.astype(np.float64))
    zeros = np.where(top == 0, MOST_ZEROS, np.minimum(52 - exponent, MOST_ZEROS)).astype(np.uint64)
    behind = np.where(zeros < 63, rest << (zeros + np.uint64(1)), np.uint64(0))
    mantissa = behind >> np.uint64(64 - MANTISSA)
    # More zeros are rarer and come first; the mantissa orders the rest.
    value = ((np.uint64(MOST_ZEROS) - zeros) << np.uint64(MANTISSA)) | mantissa
    np.minimum.at(registers, places, value.astype(np.uint16))
    return registers


def densified(registers: np.ndarray) -> np.ndarray:
    """Registers of which the empty ones borrow from the next full one, with the
    distance kept, so that sparse sets do not agree on emptiness alone."""
    full = np.flatnonzero(registers != EMPTY)
    if not len(full):
        return registers.astype(np.uint64)
    places = np.arange(REGISTERS)
    following = np.append(full, full[0] + REGISTERS)
    owner = following[np.searchsorted(full, places)]
    values = registers[owner % REGISTERS].astype(np.uint64)
    return values | ((owner - places).astype(np.uint64) << np.uint64(16))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS registers; none for an empty set."""
    if (registers == EMPTY).all():
        return np.empty(0, np.int64)
    rows = densified(registers)[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for at in range(ROWS):
        total = mixed((total + rows[:, at]) * MULTIPLIER)
    return total.view(np.int64)


def most_short(threshold: float) -> int:
    """The most shingles of a set that can be this similar to a short one."""
    return SHORT * 100 // round(threshold * 100)


def prefix_keys(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """One key for each shingle of a set's prefix, rare ones first.

    All sets are put in one order, by the count of a shingle (0 unless it is in the
    sorted ``common``) and then by its hash. Two sets with this similarity share at
    least that part of each, so the first shingles that may be missing, and one
    more, have one in common. This holds in any order.
    """
    size = len(hashes)
    often = np.zeros(size, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    length = size - -(-size * round(threshold * 100) // 100) + 1
    first = hashes[np.lexsort((hashes, often))[:length]]
    return mixed(first + MULTIPLIER).view(np.int64)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that sets of n and m different hashes agree on by
    collision: both minima in the same cell of zeros and mantissa, summed up over
    the counts of zeros, with the minima of a bucket taken as exponential."""
    a, b = np.maximum(n, 1) / REGISTERS, np.maximum(m, 1) / REGISTERS
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(40):
        high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)
        within = np.exp(-(a + b) * low) - np.exp(-(a + b) * high)
        total += low / 2**MANTISSA * a * b / (a + b) * within
    return total


def estimates(
    left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and how many
    registers each rests on."""
    used = ((left != EMPTY) | (right != EMPTY)).sum(axis=-1)
    equal = ((left == right) & (left != EMPTY)).sum(axis=-1)
    chance = chance_matches(n, m) * used
    return (equal - chance) / np.maximum(used - chance, 1), used


def may_reach(
    left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float
) -> np.ndarray:
    """Whether pairs may have this similarity, by their sizes and estimates.

    The registers used are a sample without replacement from the union, which at
    this similarity has (n + m) / (1 + threshold) hashes: where they hold most of
    them, little is left to chance.
    """
    found, used = estimates(left, right, n, m)
    union = np.maximum((n + m) / (1 + threshold), used + 1)
    spread = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * (1 - used / union))
    sized = np.minimum(n, m) >= threshold * np.maximum(n, m)
    return sized & (found >= threshold - DEVIATIONS * spread - SLACK)
