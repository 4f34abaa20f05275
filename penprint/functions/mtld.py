"""Diversity by lengths of stretches: how many tokens it takes until the type-token ratio comes down to a cut, forward and backward."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa

MTLD_CUT = 0.72


def factors(codes: Sequence[int], last: list[int], at: int) -> float:
    """Factors of one direction: a stretch ends where its type-token ratio comes down to the cut. ``last`` holds for each type the place where it came last, all before ``at``."""
    found, start, types = 0.0, at, 0
    for c in codes:
        if last[c] < start:
            types += 1
        last[c] = at
        at += 1
        if types / (at - start) <= MTLD_CUT:
            found, start, types = found + 1, at, 0
    n = at - start
    return found + ((1 - types / n) / (1 - MTLD_CUT) if n else 0.0)


def mtld(lists: pa.Array) -> pa.Array:
    """Of each list of tokens; null for one without any. Types of the batch are numbered once, and places go on from one list to the next, so that a list begins with no type seen."""
    coded = lists.flatten().dictionary_encode()
    codes, last = coded.indices.to_pylist(), [-1] * len(coded.dictionary)
    out, first, at = [], 0, 0
    for n in lists.value_lengths().fill_null(0).to_pylist():
        mine = codes[first:first + n]
        both = []
        for ordered in (mine, mine[::-1]):
            f = factors(ordered, last, at)
            both.append(n / f if f > 0 else float(n))
            at += n
        out.append((both[0] + both[1]) / 2 if n else None)
        first += n
    return pa.array(out, pa.float64())
