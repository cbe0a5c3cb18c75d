"""Near-duplicate classes by HyperMinHash, banding and confirmation on whole shingle sets.

One 64-bit hash per distinct shingle; its first bits choose a bucket, and a bucket keeps of its least
hash only the leading-zero count and ten mantissa bits (a 16-bit register).  Empty buckets borrow from
full ones along fixed random permutations.  Bands of compressed registers bring likely pairs together;
the register agreement, corrected for accidental collisions, estimates a pair's Jaccard similarity, and
what may reach the threshold is confirmed on the full sets.

Equal sets are one node from the start.  Within a band bucket each node is first held only against the
bucket's least node; a bucket whose nodes are then not all in one component has its remaining pairs
compared in blocks, so no pair of a bucket is lost, and a group of k near copies costs k comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: 42 bands of 6 registers: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, BAND_ROWS = 42, 6

_U = np.uint64
_ODD = np.random.default_rng(20).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_PROBES = np.stack([np.random.default_rng(1000 + i).permutation(BUCKETS) for i in range(BUCKETS)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased and cut at ASCII white space; words of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    coded = pc.dictionary_encode(words.flatten())
    keys = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))
    codes, counts = coded.indices.to_numpy(), pc.list_value_length(words).to_numpy().astype(np.int64)
    if len(keys) and (blank := keys == b"").any():
        real = ~blank[codes]
        counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(counts)])])
        codes = codes[real]
    return hashes[codes], counts


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: runs of ``width`` words, or all words if there are fewer; none without words."""
    words, counts = word_hashes(texts)
    n = len(words)
    shingles = np.full(n, width, _U)
    for j in range(min(width, n)):  # a batch may hold fewer words than a shingle
        shingles[: n - j] = mixed(shingles[: n - j] * _ODD[0] + words[j:])
    out, start = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(shingles[start : start + count - width + 1]))
        elif count:
            x = np.array([count], _U)
            for w in words[start : start + count]:
                x = mixed(x * _ODD[0] + w)
            out.append(x)
        else:
            out.append(np.zeros(0, _U))
        start += count
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set (sorted, distinct, not empty), one more than leading zeros and mantissa."""
    buckets = (shingles >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    rest = shingles[first] << _U(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> _U(11)).astype(np.float64))[1]
    mantissa = (rest << _U(1)) << zeros.astype(_U) >> _U(64 - MANTISSA_BITS)
    out = np.zeros(BUCKETS, np.uint16)
    out[buckets[first]] = (zeros << MANTISSA_BITS | mantissa.astype(np.int64)) + 1
    full = out > 0
    empty = np.flatnonzero(~full)
    source = out.copy()
    for attempt in range(6):
        if not len(empty):
            return out
        to = _PROBES[empty, attempt]
        hit = full[to]
        out[empty[hit]] = source[to[hit]]
        empty = empty[~hit]
    if len(empty):
        to = _PROBES[empty]
        out[empty] = source[to[np.arange(len(empty)), full[to].argmax(axis=1)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a sketch."""
    bands = sketch[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(_U)
    return mixed((bands * _ODD[1 : 1 + BAND_ROWS]).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _ODD[9]).view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities estimated from rows of registers, corrected for accidental agreement.

    The least of n hashes in m buckets has density l*exp(-l*x), l = n / m.  Two unrelated buckets agree
    if both fall into one of the cells of equal width within a leading-zero level.
    """
    agree = (a == b).mean(axis=-1)
    la, lb = np.maximum(n_a, 1) / BUCKETS, np.maximum(n_b, 1) / BUCKETS
    level = np.arange(54.0)
    both = (la + lb)[..., None]
    mass = np.exp(-both * 2.0 ** -(level + 1)) - np.exp(-both * 2.0**-level)
    chance = (mass * 2.0 ** -(level + 1 + MANTISSA_BITS)).sum(axis=-1) * la * lb / (la + lb) / (-np.expm1(-la) * -np.expm1(-lb))
    return (agree - chance) / (1 - chance)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same, len(both) - same
