"""Near-duplicates by order MinHash.

A sketch of a text is the few least of its occurrence-labelled word shingles under one hash, kept in the order of the
text; equal sketches therefore favour small edit distance. Several sketches make buckets; a pair of texts of similarity
0.8 shares none with a probability of about 3e-8 (24 sketches of 3). Candidates are verified by the Jaccard similarity
of their labelled shingles and by a banded alignment of their words; both must reach the threshold.

Exact copies become one text first. In each bucket all texts are compared with its first one; then only buckets that
still hold several groups go on, where pairs of different groups are compared, in blocks, unless a link found on the way
has joined them. So a large group of copies costs about one comparison each, and no link between groups is lost.

Defined cases: null texts are empty; all texts that are equal are one group, empty ones too; a text without words is
alike only to its equals; texts of fewer than five words are one shingle; a null id keeps its rows apart unless their
texts agree; texts that share an id are one document. Very long texts are sketched whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, doc_key, dropped, id_bound_join, kept, lots

SHINGLE, THRESHOLD, SKETCHES, LEAST = 5, 0.8, 24, 3
#: Members of a bucket that are compared in one task; larger buckets go in pairs of blocks.
BLOCK = 512
_STRIP = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”‘’„…–—¿¡"
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of a text's words: lower-cased, marks at their ends taken away; words of marks alone count only if there are no others."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        seen, raw = self.seen, text.lower().split()
        if len(seen) > 500_000:
            seen.clear()
        try:
            out = [seen[w] for w in raw]
        except KeyError:
            for w in raw:
                if w not in seen:
                    bare = w.strip(_STRIP)
                    seen[w] = (xxhash.xxh32_intdigest(bare) or 1) if bare else 0
            out = [seen[w] for w in raw]
        words = np.array(out, np.uint32)
        some = words[words != 0]
        if len(some) or not raw:
            return some
        return np.array([xxhash.xxh32_intdigest(w) or 1 for w in raw], np.uint32)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled shingles: each differs from its earlier occurrences."""
    if not len(words):
        return np.zeros(0, np.uint64)
    w = words.astype(np.uint64) + np.uint64(1)
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h + w[i:len(w) - k + 1 + i] * _P)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        at = np.arange(len(s))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        label = np.empty(len(s), np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = np.where(label > 0, mixed(h + label * _M1), h)
    return h


def sketches(labelled: np.ndarray, m: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """``m`` bucket keys: each hashes the ``least`` smallest labelled shingles in text order."""
    out = np.empty(m, np.uint64)
    size = min(least, len(labelled))
    step = max(1, 2_000_000 // max(1, len(labelled)))
    for a in range(0, m, step):
        seeds = mixed(np.arange(a + 1, min(m, a + step) + 1, dtype=np.uint64) * _P)
        x = mixed(labelled[None, :] ^ seeds[:, None])
        at = np.sort(np.argpartition(x, size - 1, axis=1)[:, :size], axis=1)
        key = seeds.copy()
        for c in range(size):
            key = mixed(key * _P + labelled[at[:, c]])
        out[a:a + len(seeds)] = key
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of labelled shingles, each without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether edit distance in words is at most ``(1 - threshold) * longer``, by furthest points on a band of diagonals."""
    n, m = len(a), len(b)
    band = int((1 - threshold) * max(n, m) + 1e-9)
    if abs(n - m) > band:
        return False
    misses: dict[int, list[int]] = {}

    def run(i: int, d: int) -> int:
        """From a[i], b[i + d] on as far as both agree."""
        if d not in misses:
            lo, hi = max(0, -d), min(n, m - d)
            misses[d] = [*(np.flatnonzero(a[lo:hi] != b[lo + d:hi + d]) + lo).tolist(), hi]
        at = misses[d]
        return at[bisect.bisect_left(at, i)] if i <= at[-1] else i

    far = {0: run(0, 0)}
    for e in range(band + 1):
        if far.get(m - n, -1) >= n:
            return True
        step = {}
        for d in range(-min(e + 1, band), min(e + 1, band) + 1):
            best = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            if best >= 0 and best >= -d:
                best = min(best, n, m - d)
                if best >= max(0, -d):
                    step[d] = run(best, d)
        far = step
    return False


def alike(a: np.ndarray, b: np.ndarray, k: int, threshold: float, sa: np.ndarray | None = None, sb: np.ndarray | None = None) -> bool:
    sa, sb = shingles(a, k) if sa is None else sa, shingles(b, k) if sb is None else sb
    return min(len(sa), len(sb)) >= threshold * max(len(sa), len(sb)) and jaccard(sa, sb) >= threshold and aligned(a, b, threshold)


def _sketched(batches: Iterator[pa.RecordBatch], k: int, m: int, least: int) -> Iterator[pa.RecordBatch]:
    words_of = Words()
    for batch in lots(batches):
        words, keys = [], []
        for text in batch.column("text").to_pylist():
            w = words_of(text or "")
            words.append(w.tobytes())
            keys.append(sketches(shingles(w, k), m, least).view(np.int64) if len(w) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("digest"), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["k", "digest", "words", "keys"])


def _verified(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    last, first, found = None, None, None
    for batch in batches:
        src, dst = [], []
        for a, b, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("src", "dst", "wa", "wb")), strict=True):
            if a != last:
                last, first = a, np.frombuffer(wa, np.uint32)
                found = shingles(first, k)
            other = np.frombuffer(wb, np.uint32)
            if alike(first, other, k, threshold, found):
                src.append(a)
                dst.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _across(group: pa.Table, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between different groups of one bucket; after a link its two groups count as one."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("rep", "comp", "band", "block", "n", "words", "keys", "low", "high")), strict=True), key=lambda r: (r[4], r[0]))
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while top.get(c, c) != c:
            top[c] = top.get(top[c], top[c])
            c = top[c]
        return c

    words = [np.frombuffer(r[5], np.uint32) for r in rows]
    keys = np.array([r[6] for r in rows], np.int64)
    block, n = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    low, high, band = rows[0][7], rows[0][8], rows[0][2]
    # pairs of these two blocks, and of one group no more; one that meets in an earlier bucket too is compared there
    open_pairs = np.triu((block[:, None] == low) & (block[None, :] == high) | (block[:, None] == high) & (block[None, :] == low), 1)
    comp = np.array([r[1] for r in rows])
    open_pairs &= comp[:, None] != comp[None, :]
    open_pairs &= n[:, None] >= threshold * n[None, :]  # rows are sorted by n
    for b in range(band):
        open_pairs &= keys[:, b][:, None] != keys[:, b][None, :]
    src, dst = [], []
    if open_pairs.any():
        sets = [shingles(w, k) for w in words]
        size = np.array([len(x) for x in sets])
        both = shared_counts(sets)
        open_pairs &= both >= threshold * (size[:, None] + size[None, :] - both)
        for i, j in np.argwhere(open_pairs).tolist():
            if root(rows[i][1]) != root(rows[j][1]) and aligned(words[i], words[j], threshold):
                src.append(rows[i][0])
                dst.append(rows[j][0])
                top[root(rows[i][1])] = root(rows[j][1])
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def shared_counts(sets: list[np.ndarray], each: int = 4_096) -> np.ndarray:
    """How many elements each two of the sets share: products of their incidence matrices, ``each`` elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    out = np.zeros((len(sets), len(sets)), np.int64)
    np.fill_diagonal(out, [len(x) for x in sets])
    order = np.argsort(place[which], kind="stable")
    column, owner = place[which][order], owner[order]
    for first in range(0, len(shared), each):
        a, b = np.searchsorted(column, [first, first + each])
        held = np.zeros((len(sets), min(each, len(shared) - first)), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        part = (held @ held.T).astype(np.int64)
        np.fill_diagonal(part, 0)
        out += part
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, m: int = SKETCHES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, class_id, kept`` for every row: the class is the least key among documents that links connect.

    ``key`` is the id, or for a null id a negative number made of the text; ``kept`` marks the rows of the class's first document.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(doc_key(id_col, text_col).alias("k"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    sketched, sketch_path = kept(rows.mapInArrow(lambda b: _sketched(b, k, m, least), "k long, digest binary, words binary, keys array<long>"))
    # counts are written before rows meet them in a join: its two sides are then plain exchanges, whose hot keys split
    copies, copies_path = kept(sketched.groupBy("digest").agg(F.min("k").alias("rep")))
    members, member_path = kept(sketched.select("k", "digest").join(copies, "digest").select("k", "rep", "digest").distinct())
    texts = sketched.select(F.col("k").alias("rep"), "digest", "words", "keys")
    first = members.where("k = rep").select("rep", "digest")

    # buckets of two texts or more, and in each the pairs with its first text
    keys = texts.select("rep", "digest", "keys").join(first, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]).select("rep", F.posexplode("keys").alias("band", "bucket"))
    keys, key_path = kept(keys)
    leads = keys.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last")
    leads, leads_path = kept(leads)
    shared, shared_path = kept(keys.join(leads, "bucket").select("bucket", "band", "rep", "lead"))
    pairs, pair_path = kept(shared.where("rep <> lead").select(F.col("lead").alias("src"), F.col("rep").alias("dst")).distinct())
    needed, needed_path = kept(shared.select("rep").distinct())
    # the words of those texts only; a text that several rows share is read once
    found = id_bound_join(texts.select("rep", "digest", "words", "keys"), needed, needed_path, "rep", "left_semi").join(first, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"])
    found, found_path = kept(found.select("rep", "words", "keys"))

    one = found.select(F.col("rep").alias("dst"), F.col("words").alias("wb"))
    two = found.select(F.col("rep").alias("src"), F.col("words").alias("wa"))
    link = "src long, dst long"
    links, link_path = kept(pairs.join(one, "dst").join(two, "src").select("src", "dst", "wa", "wb").mapInArrow(lambda b: _verified(b, k, threshold), link))

    # buckets that still hold several groups
    comp = components(links)
    held = shared.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    held, held_path = kept(held)
    # Members of a bucket's largest group need no comparison among themselves: blocks of the rest come first, and every pair of
    # blocks has one of them.
    groups = held.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    several = groups.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("major"), F.sum("c").alias("c"), F.count("*").alias("groups")).where("groups > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    several = several.select("bucket", F.col("major.comp").alias("major"), blocks(F.col("c") - F.col("major.c")).alias("rest"), blocks(F.col("major.c")).alias("most"))
    several, several_path = kept(several)
    mixed_rows = held.join(several, "bucket").withColumn("h", F.xxhash64("rep"))
    inner = F.col("comp") == F.col("major")
    mixed_rows = mixed_rows.withColumn("block", F.when(inner, F.col("rest") + F.pmod("h", "most")).otherwise(F.pmod("h", "rest")).cast("int"))
    mixed_rows = mixed_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)))
    mixed_rows = mixed_rows.select("bucket", "band", "rep", "comp", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    sized = found.withColumn("n", F.greatest(F.lit(1), F.octet_length("words") / 4 - (k - 1)).cast("long"))
    more = by_group(mixed_rows.join(sized, "rep"), ["bucket", "low", "high"], lambda t: _across(t, k, threshold), link)
    more, more_path = kept(more)
    if more.isEmpty():
        comp_all = comp
    else:
        comp_all = components(links.unionByName(more))
    # texts that one id shares are one document, so classes join over ids as well
    ids = members.groupBy("k").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    if not ids.isEmpty():
        comp_all = components(links.unionByName(more).unionByName(members.where("k <> rep").select(F.col("k").alias("src"), F.col("rep").alias("dst"))))
    classes = members.join(comp_all.withColumnRenamed("node", "rep"), "rep", "left").groupBy("k").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    out = docs.select(F.col(id_col).alias("doc_id"), doc_key(id_col, text_col).alias("key")).join(classes.withColumnRenamed("k", "key"), "key")
    out, _ = kept(out.select("doc_id", "key", "class_id", (F.col("key") == F.col("class_id")).alias("kept")))
    dropped(spark, sketch_path, copies_path, leads_path, several_path, member_path, key_path, shared_path, pair_path, needed_path, found_path, link_path, held_path, more_path)
    return out
