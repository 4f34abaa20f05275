"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

1. *Anchors.* In every window of ``length`` bytes the leftmost k-gram of least hash is an anchor. Equal windows have equal
   anchors, so a repeat is seen from anchors alone, about two in every window. The offsets at which a window may lie around
   its anchor fall into two halves; all windows of a half share a *core*, and lie in an *outer* string. A run of a short
   period that is longer than a window repeats within itself; only the windows of its first period have anchors.
2. *Candidates.* Cores are counted over all texts. One that occurs once ends there. Anchors whose whole outer string
   occurs again are settled: all their windows repeat. Equal outer strings are one from here on, with their count.
3. *Sorting.* What is left, the ends of repeats, is sorted as suffixes that start at cores, and as prefixes read back
   from them, by deep-shallow sorting: multikey quicksort to a shallow depth, then a blind trie for each group whose
   common prefix goes deeper. In these two orders the strings that share a window lie side by side: for each offset,
   ranks at the two match lengths tell which windows occur twice. The core itself is compared by a 128-bit digest.
   A core with very many different outer strings goes another exact way: its half is cut in parts, each with a longer core
   and a shorter outer string, which are counted in the same way; of what is left the windows' 128-bit digests are counted.
4. *Removal.* A document's covered ranges are merged and cut out.

Matches never cross documents, and strings are judged on the input. Exact copies of a text count by number.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; copies of a text of ``length`` bytes or
more, repeated rows as well, lose all of it; a null id keeps its rows apart unless their texts agree; an empty table
gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, dropped, id_bound_join, kept, lots, partitions_for

LENGTH, GRAM = 400, 32
#: Bytes that multikey quicksort looks at, different outer strings of a core that are sorted in one task, strings in a task.
SHALLOW, MOST_OUTER, EACH = 32, 1_000, 6_000
#: Parts of a hot core's half; bytes of a digest.
PARTS, DIGEST = 8, 16
_P = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of each k-gram; k is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    p, step = _P, 1
    while step < k:
        h = h[:-step] * np.uint64(p) + h[step:]
        p, step = p * p & 0xFFFFFFFFFFFFFFFF, step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[:len(values) - (width - step)], values[width - step:]) if step < width else values


def anchors_by_half(data: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """For each half the places of the k-grams that are least in some window of ``length`` bytes that starts in that half,
    the leftmost where several are least; and the periodic runs, which are settled as they are.

    A run of period p and of ``length + p`` bytes or more is covered: its windows start again p bytes on. Windows that lie
    in it beyond the first p are equal to one of those, so they have no anchors.
    """
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 2, []
    text = np.frombuffer(data, np.uint8)
    h = gram_hashes(text, k)
    width = length - k + 1
    pad = np.zeros(width - 1, np.uint64)
    least = np.concatenate([pad, sliding(h, width, np.minimum), pad])
    # the greatest of the least values over windows that hold a place is its own hash where it is least in one of them
    pick = lambda: [np.flatnonzero(sliding(least, b - a + 1, np.maximum)[width - 1 - b:][:len(h)] == h) for a, b in halves(length, k)]
    found = pick()
    at, before = _again(np.union1d(*found), h, width)
    if not len(at):
        return found, []
    runs = periodic_runs(text, before, at - before, length)
    for a, b, p in runs:
        least[width - 1 + a + p:width + b - length] = 0
    if runs:
        found = pick()
        at, before = _again(np.union1d(*found), h, width)
    known = dict(zip(at.tolist(), before.tolist(), strict=True))
    for i, (a, b) in enumerate(halves(length, k)):
        # a place that follows an equal one is the first only in windows that start after that
        late = [m for m in found[i].tolist() if m in known and not (least[width - 1 + max(m - b, known[m] + 1):width + m - a] == h[m]).any()]
        if late:
            found[i] = np.setdiff1d(found[i], late)
    return found, [(a, b) for a, b, _ in runs]


def _again(places: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that have an equal hash less than ``width`` before, and where that is."""
    order = np.lexsort((places, h[places]))
    at, hashes = places[order], h[places[order]]
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (np.diff(at) < width))
    return at[same + 1], at[same]


def periodic_runs(text: np.ndarray, at: np.ndarray, gaps: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """``start, end, period`` of the maximal runs of ``length`` and a period more, found from places that occur again ``gaps`` on."""
    out = set()
    for p in np.unique(gaps[gaps <= length // 2]).tolist():
        # ends of the stretches in which every byte returns p bytes on
        breaks = np.concatenate([[-1], np.flatnonzero(text[:-p] != text[p:]), [len(text) - p]])
        i = np.unique(np.searchsorted(breaks, at[gaps == p]))
        i = i[(i > 0) & (i < len(breaks))]
        out |= {(a, b, p) for a, b in zip((breaks[i - 1] + 1).tolist(), (breaks[i] + p).tolist(), strict=True) if b - a >= length + p}
    return sorted(out)


def anchors(data: bytes, length: int = LENGTH, k: int = GRAM) -> np.ndarray:
    """Places of the k-grams that are least in some window of ``length`` bytes that needs an anchor."""
    return np.union1d(*anchors_by_half(data, length, k)[0]).astype(np.int64)


def halves(length: int, k: int) -> list[tuple[int, int]]:
    """The two ranges (both ends in it) of how far a window's start lies before its anchor."""
    width = length - k + 1
    return [(0, (width - 1) // 2), ((width - 1) // 2 + 1, width - 1)]


def _anchored(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor and half: its place, and 64-bit hashes of core and outer string; for each periodic run a row
    of half -1, with its start and, as ``outer``, its end."""
    from xxhash import xxh3_64_intdigest

    parts = halves(length, k)
    for batch in lots(batches):
        counts, places, of_half, cores, outers = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            n, before = len(data), len(places)
            by_half, runs = anchors_by_half(data, length, k)
            for start, end in runs:
                places.append(start)
                of_half.append(-1)
                cores.append(0)
                outers.append(end)
            # equal windows have their least k-gram at the same place, so a half in which a k-gram is least nowhere needs no row
            for half, found in enumerate(by_half):
                a, b = parts[half]
                for m in found.tolist():
                    lo, hi = m - a, m - b + length
                    start, end = max(0, m - b), min(n, m - a + length)
                    places.append(m)
                    of_half.append(half)
                    cores.append(xxh3_64_intdigest(data[lo:hi], half))
                    # where the text cuts it short, an outer string equals only those that are cut alike
                    outers.append(xxh3_64_intdigest(data[start:end], (lo - start) * 1_000 + end - hi + 1_000_000))
            counts.append(len(places) - before)
        at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cores, outers)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("k", "mark", "weight")), pa.array(places, pa.int32()), pa.array(of_half, pa.int8()), *hashes], ["k", "mark", "weight", "pos", "half", "core", "outer"])


# --- deep-shallow sorting


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    """An inner node of a blind trie: only the place and the branching characters are kept."""

    __slots__ = ("at", "kids")

    def __init__(self, at: int, kids: dict):
        self.at, self.kids = at, kids


def blind_trie_order(strings: list[bytes], ids: list[int], depth: int) -> list[int]:
    """The ids sorted by their strings, which agree in the first ``depth`` bytes. -1 is the end of a string."""
    root: _Node | list[int] = [ids[0]]
    for i in ids[1:]:
        s = strings[i]
        # blindly down to some leaf, reading only branching places
        node = root
        while isinstance(node, _Node):
            c = s[node.at] if node.at < len(s) else -1
            node = node.kids.get(c) or next(iter(node.kids.values()))
        leaf = strings[node[0]]
        d = depth + lcp(s[depth:], leaf[depth:])
        if d == len(s) == len(leaf):
            node.append(i)
            continue
        mine, other = (s[d] if d < len(s) else -1), (leaf[d] if d < len(leaf) else -1)
        # down again to where the true common prefix ends
        above, node = None, root
        while isinstance(node, _Node) and node.at < d:
            c = s[node.at] if node.at < len(s) else -1
            above, node = (node, c), node.kids[c]
        if isinstance(node, _Node) and node.at == d:
            node.kids[mine] = [i]
        else:
            fresh = _Node(d, {other: node, mine: [i]})
            if above is None:
                root = fresh
            else:
                above[0].kids[above[1]] = fresh
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(node.kids[c] for c in sorted(node.kids, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort on their first ``shallow`` bytes, 8 at a time, then blind tries."""
    n = len(strings)
    if not n:
        return []
    words = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    out: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)]
    while stack:
        ids, column = stack.pop()
        if column == words.shape[1]:
            group = ids.tolist()
            # padded ends look like zero bytes; the trie tells them apart, so it starts where none can differ
            known = min(shallow, min(len(strings[i]) for i in group))
            out.extend(blind_trie_order(strings, group, known) if len(group) > 1 else group)
        elif len(ids) == 1:
            out.append(int(ids[0]))
        else:
            key = words[ids, column]
            pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
            less, more = key < pivot, key > pivot
            for part, col in ((ids[more], column), (ids[~(less | more)], column + 1), (ids[less], column)):
                if len(part):
                    stack.append((part, col))
    return out


def repeated_range(left: list[bytes], right: list[bytes], weight: np.ndarray, core_size: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the least and greatest ``t`` so that ``t`` bytes to the left and ``span - t`` to the right of its
    core occur twice, -1 if there is none. ``left`` is read backwards, ``right`` begins with what stands for the core."""
    n = len(left)
    r_order, l_order = np.array(deep_shallow_order(right)), np.array(deep_shallow_order(left))
    near = lambda strings, order: np.array([0, *(lcp(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True))], np.int64)
    r_near, l_near = near(right, r_order), near(left, l_order)
    r_size, l_size = np.array([len(s) for s in right]) - core_size, np.array([len(s) for s in left])
    least, most = np.full(n, -1), np.full(n, -1)
    r_rank, l_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(span + 1):
        r_rank[r_order] = np.cumsum(r_near < core_size + span - t)
        l_rank[l_order] = np.cumsum(l_near < t)
        ok = np.flatnonzero((r_size >= span - t) & (l_size >= t))
        if not len(ok):
            continue
        _, which = np.unique(r_rank[ok] * (n + 1) + l_rank[ok], return_inverse=True)
        hit = ok[np.bincount(which, weights=weight[ok])[which] >= 2]
        least[hit] = np.where(least[hit] < 0, t, least[hit])
        most[hit] = t
    return least, most


def _sorted_ranges(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges among the strings of one partition, which has whole groups of cores."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    half_of = np.array(rows.column("half").to_pylist())
    for half, (a, b) in enumerate(halves(length, k)):
        part = rows.filter(pa.array(half_of == half))
        if not part.num_rows:
            continue
        left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
        least, most = repeated_range(left, right, part.column("weight").to_numpy(), DIGEST, b - a)
        at = np.flatnonzero(least >= 0)
        pos = part.column("pos").to_numpy()[at].astype(np.int64)
        hit = part.select(["k", "mark"]).take(pa.array(at)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(hit.column(c).combine_chunks() if hit.num_rows else pa.array([], hit.schema.field(c).type) for c in ("k", "mark")), pa.array(pos - a - most[at]), pa.array(pos - a - least[at] + length)], ["k", "mark", "start", "end"])


def _sliced(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The strings around the anchors asked for: to the left of the core backwards, and the core's digest with what follows the core."""
    from xxhash import xxh3_128_digest

    parts = halves(length, k)
    for batch in lots(batches):
        out: dict[str, list] = {c: [] for c in ("k", "mark", "pos", "half", "core", "weight", "left", "right")}
        for key, mark, text, spots in zip(*(batch.column(c).to_pylist() for c in ("k", "mark", "text", "spots")), strict=True):
            data = (text or "").encode()
            for s in spots:
                a, b = parts[s["half"]]
                lo, hi = s["pos"] - a, s["pos"] - b + length
                for c in ("pos", "half", "core", "weight"):
                    out[c].append(s[c])
                out["k"].append(key)
                out["mark"].append(mark)
                out["left"].append(data[max(0, s["pos"] - b):lo][::-1])
                out["right"].append(xxh3_128_digest(data[lo:hi]) + data[hi:s["pos"] - a + length])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))


def _strips(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """For each anchor of a hot core the stretch of text that holds all windows of its half, and where that begins."""
    parts = halves(length, k)
    for batch in lots(batches):
        out: list[tuple] = []
        for key, mark, text, spots in zip(*(batch.column(c).to_pylist() for c in ("k", "mark", "text", "spots")), strict=True):
            data = (text or "").encode()
            for s in spots:
                a, b = parts[s["half"]]
                first = max(0, s["pos"] - b)
                out.append((key, mark, s["pos"], s["half"], s["weight"], first, data[first:s["pos"] - a + length]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int8(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["k", "mark", "pos", "half", "weight", "first", "strip"])


def _narrowed(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each half of a hot core in :data:`PARTS` parts: ``core`` and ``outer`` digests, and the windows' first and last start."""
    from xxhash import xxh3_128_digest

    halved = halves(length, k)
    for batch in lots(batches):
        out: list[tuple] = []
        for key, mark, pos, half, weight, first, data in zip(*(batch.column(c).to_pylist() for c in ("k", "mark", "pos", "half", "weight", "first", "strip")), strict=True):
            (a, b), n, at = halved[half], len(data), pos - first
            step = -(-(b - a + 1) // PARTS)
            for x in range(a, b + 1, step):
                y = min(b, x + step - 1)
                lo, hi = at - x, at - y + length
                if lo < 0 or hi > n:
                    continue
                start, end = max(0, at - y), min(n, at - x + length)
                out.append((xxh3_128_digest(data[lo:hi], x), xxh3_128_digest(data[start:end], (lo - start) * 1_000 + end - hi), key, mark, pos, half, weight, first + start, first + end - length))
        if out:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int8(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["core", "outer", "k", "mark", "pos", "half", "weight", "start", "last"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digests of all windows of the parts that counting cores and outer strings leaves open."""
    from xxhash import xxh3_128_digest

    for batch in lots(batches):
        out: list[tuple] = []
        for key, mark, first, data, parts in zip(*(batch.column(c).to_pylist() for c in ("k", "mark", "first", "strip", "parts")), strict=True):
            weight: dict[int, int] = {}
            for s in parts:
                for i in range(s["start"] - first, s["last"] - first + 1):
                    weight[i] = max(weight.get(i, 0), s["weight"])
            out.extend((xxh3_128_digest(data[i:i + length]), key, mark, first + i, w) for i, w in weight.items())
        if out:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int8())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["window", "k", "mark", "start", "weight"])


def _hot_ends(strips: DataFrame, length: int, k: int, paths: list[str]) -> DataFrame:
    """``k, mark, start, end`` of the repeats around anchors of hot cores; written tables are added to ``paths``."""
    def written(df: DataFrame) -> DataFrame:
        out, path = kept(df)
        paths.append(path)
        return out

    parts = written(strips.mapInArrow(lambda b: _narrowed(b, length, k), "core binary, outer binary, k long, mark long, pos int, half tinyint, weight tinyint, start long, last long"))
    outers = written(parts.groupBy("core", "outer").agg(F.sum("weight").alias("times"), F.min(F.struct("k", "mark", "pos", "half", "start", "last")).alias("at")))
    settled = parts.join(outers.where("times >= 2").select("core", "outer"), ["core", "outer"], "left_semi").select("k", "mark", "start", (F.col("last") + length).alias("end"))
    # cores with different outer strings, one of them at least met once; of equal outer strings one stands for all
    open_cores = written(outers.groupBy("core").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds >= 2 and least < 2").select("core"))
    left = outers.join(open_cores, "core").select(F.least("times", F.lit(2).cast("long")).cast("byte").alias("weight"), "at.*")
    spot = ["k", "mark", "pos", "half"]
    left = written(left.groupBy(*spot).agg(F.collect_list(F.struct("start", "last", "weight")).alias("parts")))
    windows = written(strips.drop("weight").dropDuplicates(spot).join(left, spot).mapInArrow(lambda b: _windows(b, length), "window binary, k long, mark long, start long, weight tinyint"))
    # a window repeats if it has two different places or stands for two; one place may come from several anchors
    place = F.xxhash64("k", "mark", "start")
    again = written(windows.groupBy("window").agg(F.max("weight").alias("w"), F.min(place).alias("a"), F.max(place).alias("b")).where("w >= 2 or a <> b").select("window"))
    found = windows.where("weight < 2").join(again, "window", "left_semi").select("k", "mark", "start", (F.col("start") + length).alias("end"))
    return settled.unionByName(found)


# --- removal


def _digest(text: Column) -> Column:
    """128 bits of a text's SHA-256, by which exact copies meet."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST)


def _mark(text: Column) -> Column:
    """64 bits that tell apart the texts of one id."""
    return F.xxhash64(text)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without the bytes of characters that they hold only in part."""
    out = []
    for a, b in ranges:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def passages(data: bytes, ranges: list[tuple[int, int]], words: int, whole: int = LENGTH) -> list[tuple[int, int]]:
    """The ranges that hold so many words, or ``whole`` bytes."""
    return [(a, b) for a, b in ranges if b - a >= whole or len(data[a:b].split()) >= words]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``key, text_mark, ranges`` for the texts that lose bytes: their merged byte ranges, sorted; and where it is written."""
    spark = docs.sparkSession
    paths: list[str] = []

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        out, path = kept(df)
        paths.append(path)
        return out, path

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(doc_key(id_col, text_col).alias("k"), _mark(text).alias("mark"), text.alias("text")).where(F.octet_length("text") >= length)
    # One text for all its exact copies; copies lose everything. A row that repeats has copies, so it weighs 2 as it is.
    sizes, _ = written(base.select("k", "mark", _digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size")))
    copies, copies_path = written(sizes.groupBy("digest").agg(F.min("k").alias("rep"), F.count("*").alias("n")).where("n >= 2").select("digest", "rep"))
    whole = sizes.join(copies.select("digest"), "digest").select("k", "mark", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    reps = id_bound_join(base.withColumn("digest", _digest(F.col("text"))), copies, copies_path, "digest", "left").where("rep is null or rep = k")
    reps = reps.select("k", "mark", F.when(F.col("rep").isNull(), 1).otherwise(2).cast("byte").alias("weight"), "text")
    spots, _ = written(reps.mapInArrow(lambda b: _anchored(b, length, k), "k long, mark long, weight tinyint, pos int, half tinyint, core long, outer long"))
    # counts are written before rows meet them in a join: its two sides are then plain exchanges, whose hot keys split
    runs = spots.where("half < 0").select("k", "mark", F.col("pos").cast("long").alias("start"), F.col("outer").alias("end"))
    spots = spots.where("half >= 0")
    cores, _ = written(spots.groupBy("core").agg(F.sum("weight").alias("times")).where("times >= 2").select("core"))
    live, _ = written(spots.join(cores, "core"))
    # core and outer string by two hashes of 64 bits: only outer strings of one core could be taken for each other
    outers, _ = written(live.groupBy("core", "outer").agg(F.sum("weight").alias("weight"), F.min(F.struct("k", "mark", "pos", "half")).alias("at")))
    twice = outers.where("weight >= 2").select("core", "outer")  # one row for each key
    parts = halves(length, k)
    low = F.when(F.col("half") == 0, parts[0][1]).otherwise(parts[1][1])
    high = F.when(F.col("half") == 0, parts[0][0]).otherwise(parts[1][0])
    settled = live.join(twice, ["core", "outer"], "left_semi").select("k", "mark", F.greatest(F.lit(0), F.col("pos") - low).cast("long").alias("start"), (F.col("pos") - high + length).cast("long").alias("end"))
    # the ends of repeats: cores with different outer strings, one of them at least met once
    groups, _ = written(outers.groupBy("core").agg(F.count("*").alias("kinds"), F.min("weight").alias("least")).where("kinds >= 2 and least < 2"))
    wanted, _ = written(outers.join(groups, "core").select("core", F.least("weight", F.lit(2).cast("long")).cast("byte").alias("weight"), (F.col("kinds") > MOST_OUTER).alias("hot"), "at.*"))
    cold, hot = wanted.where("not hot"), wanted.where("hot")
    asked = cold.groupBy("k", "mark").agg(F.collect_list(F.struct("pos", "half", "core", "weight")).alias("spots"))
    # rows that repeat weigh 2 already, so strings that they give twice change nothing
    slices = base.join(asked.hint("merge"), ["k", "mark"]).mapInArrow(lambda b: _sliced(b, length, k), "k long, mark long, pos int, half tinyint, core long, weight tinyint, left binary, right binary")
    ends = slices.repartition(partitions_for(spark, cold.count(), EACH), "core").mapInArrow(lambda b: _sorted_ranges(b, length, k), "k long, mark long, start long, end long")
    if not hot.isEmpty():
        asked_hot, hot_path = written(hot.groupBy("k", "mark").agg(F.collect_list(F.struct("pos", "half", "weight")).alias("spots")))
        strips, _ = written(id_bound_join(base, asked_hot, hot_path, ["k", "mark"]).mapInArrow(lambda b: _strips(b, length, k), "k long, mark long, pos int, half tinyint, weight tinyint, first long, strip binary"))
        ends = ends.unionByName(_hot_ends(strips, length, k, paths))
    every = settled.unionByName(ends).unionByName(whole).unionByName(runs)
    union = F.udf(lambda r: [list(x) for x in merged([(a["start"], a["end"]) for a in r])], "array<array<long>>", useArrow=True)
    # a window that begins near the end of its text goes no further than the text
    size = sizes.groupBy("k", "mark").agg(F.max("size").alias("size"))
    out = every.groupBy("k", "mark").agg(F.collect_set(F.struct("start", "end")).alias("r")).join(size, ["k", "mark"])
    clipped = F.transform("r", lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], F.col("size")).alias("end")))
    out, out_path = kept(out.select(F.col("k").alias("key"), F.col("mark").alias("text_mark"), union(clipped).alias("ranges")))
    dropped(spark, *paths)
    return out, out_path


def _with_ranges(docs: DataFrame, ranges: tuple[DataFrame, str], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.withColumn("__key", doc_key(id_col, text_col))
    own = ranges[0].withColumnsRenamed({"key": "__key", "text_mark": "__d", "ranges": "__ranges", "runs": "__runs"})
    # a text is known by its key and its mark: texts that share an id keep apart
    return id_bound_join(both.withColumn("__d", _mark(text)), own, ranges[1], ["__key", "__d"], "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int = 0, whole: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col``; a character goes only if all its bytes do.

    With ``words`` a run goes only if it holds so many words, or ``whole`` bytes: passages are told by their words, while
    lines and phrases that happen to be longer than ``length`` stay. Other columns may have any names.
    """
    names = docs.columns
    ranges = repeated_ranges(docs.select(id_col, text_col), length, id_col=id_col, text_col=text_col)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts, found = batch.column("__t").to_pylist(), batch.column("__r").to_pylist()
            out = []
            for t, r in zip(texts, found, strict=True):
                if t is None or not r:
                    out.append(t)
                else:
                    data = t.encode()
                    out.append(cut(data, whole_characters(data, passages(data, r, words, whole))).decode())
            # the columns are inner names and numbers, so that any names may be there
            others = iter(batch.columns[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else next(others) for c in names], names)

    rest = [(c, f"__c{i}") for i, c in enumerate(names) if c != text_col]
    both = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in rest], F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("__t"))
    joined = _with_ranges(both, ranges, "__i", "__t")
    rows = joined.select(*[x for _, x in rest], "__t", F.col("__ranges").alias("__r"))
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(rewritten, schema)


def removal_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", passage: int = 0, words: int = 0) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    With ``passage`` a second search follows, by strings of so many bytes: ``n_passages, n_passage_bytes`` are the maximal runs
    that those cover and that hold ``words`` words or ``length`` bytes. The columns before say nothing of shorter repeats.
    """
    texts = docs.select(id_col, text_col)
    ranges = repeated_ranges(texts, length, id_col=id_col, text_col=text_col)
    if passage:
        runs = repeated_ranges(texts, passage, id_col=id_col, text_col=text_col)
        both = kept(ranges[0].join(runs[0].withColumnRenamed("ranges", "runs"), ["key", "text_mark"], "full"))
        dropped(docs.sparkSession, ranges[1], runs[1])
        ranges = both
    more = ["n_passages", "n_passage_bytes"] if passage else []

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            out = []
            runs = batch.column("p").to_pylist() if passage else [None] * batch.num_rows
            for t, r, p in zip(batch.column("t").to_pylist(), batch.column("r").to_pylist(), runs, strict=True):
                data, r = (t or "").encode(), r or []
                p = passages(data, p or [], words, length)
                own = (len(p), sum(b - a for a, b in p)) if passage else ()
                out.append((len(data), sum(b - a for a, b in r), len(r), hashlib.sha256(cut(data, r)).hexdigest(), *own))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more]) if out else batch.select(["doc_id"])

    joined = _with_ranges(docs.select(F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("__t")), ranges, "__i", "__t")
    rows = joined.select(F.col("__i").alias("doc_id"), F.col("__t").alias("t"), F.col("__ranges").alias("r"), *([F.col("__runs").alias("p")] if passage else []))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.where(F.lit(True)).mapInArrow(digested, ", ".join([f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(f"{c} long" for c in more)]))
