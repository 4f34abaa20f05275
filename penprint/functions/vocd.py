"""Diversity by the curve of type-token ratios over samples of growing size, drawn by hashes so that reruns agree."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np

VOCD_SIZES, VOCD_SAMPLES, VOCD_LOW, VOCD_HIGH, VOCD_STEPS = range(35, 51), 100, 0.01, 10_000.0, 80
VOCD_SEED = "penprint_vocd_v1"


#: Places by (number of tokens, seed): texts of one length share their samples.
_CACHE: dict[tuple[int, str], tuple[np.ndarray, ...]] = {}


def least(scores: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` least scores, in any order; among equal ones the first."""
    if size >= len(scores):
        return np.arange(len(scores))
    edge = np.partition(scores, size - 1)[size - 1]
    below = np.flatnonzero(scores < edge)
    return np.concatenate([below, np.flatnonzero(scores == edge)[:size - len(below)]])


def samples(n: int, seed: str) -> tuple[np.ndarray, ...]:
    """Places of each sample, for a text of n tokens: for each size an array (samples, size), by the least hashes."""
    if (n, seed) in _CACHE:
        return _CACHE[n, seed]
    out, places = [], [str(i).encode() for i in range(n)]
    for size in VOCD_SIZES:
        rows = []
        for sample in range(VOCD_SAMPLES):
            begin = f"{seed}:{n}:{size}:{sample}:".encode()
            rows.append(least(np.frombuffer(b"".join([blake2b(begin + i, digest_size=8).digest() for i in places]), ">u8").astype(np.uint64), size))
        out.append(np.array(rows))
    if len(_CACHE) >= 64:
        _CACHE.clear()
    _CACHE[n, seed] = tuple(out)
    return _CACHE[n, seed]


def ttr_curve(size: float, d: float) -> float:
    return d / size * (math.sqrt(1 + 2 * size / d) - 1)


def fit_curve(points: list[tuple[int, float]]) -> float:
    """The diversity whose curve comes nearest to the points, by golden section."""
    golden, low, high = (math.sqrt(5) - 1) / 2, VOCD_LOW, VOCD_HIGH
    miss = lambda d: sum((ttr_curve(n, d) - t) ** 2 for n, t in points)
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = miss(a), miss(b)
    for _ in range(VOCD_STEPS):
        if fa > fb:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = miss(b)
        else:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = miss(a)
    return (low + high) / 2


def vocd(tokens: list[str] | None, seed: str = VOCD_SEED) -> dict:
    """``d, fast, reason`` of one text."""
    tokens = tokens or []
    if len(tokens) < max(VOCD_SIZES):
        return {"d": None, "fast": None, "reason": "below_vocd_50_token_threshold" if tokens else "zero_tokens"}
    codes = np.unique(np.array(tokens, object), return_inverse=True)[1]
    points = []
    for size, places in zip(VOCD_SIZES, samples(len(tokens), seed), strict=True):
        drawn = np.sort(codes[places], axis=1)
        points.append((size, float(np.mean((1 + (drawn[:, 1:] != drawn[:, :-1]).sum(axis=1)) / size))))
    if all(t >= 1 for _, t in points):
        return {"d": None, "fast": None, "reason": "all_samples_unique_vocd_singularity"}
    inverse = [n * t * t / (2 * (1 - t)) for n, t in points if t < 1]
    return {"d": fit_curve(points), "fast": sum(inverse) / len(inverse), "reason": None}
