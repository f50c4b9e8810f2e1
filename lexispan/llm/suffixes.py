"""Operator 6: bytes in repeated substrings, by deep-shallow sorting of the suffixes that matter.

Every window of ``length`` bytes has one anchor, the place of the least hash among its short
substrings; equal windows have equal anchors at equal distances. The windows of one anchor make a
fragment: the bytes from the first window's start to the last one's end. So only anchors with equal
hashes have to be compared, and fragments that are equal as a whole are known by their hash.

Where different fragments share an anchor, the suffixes that begin at the anchors are sorted, and so
are the reversed prefixes that end there, by deep-shallow sorting: multikey quicksort to a shallow
depth, then blind tries for groups whose common prefixes go deeper. Two fragments have a window in
common if their common bytes before and after the anchor reach ``length`` together; merging the
intervals of the suffix order from the longest common prefix down, with the members of each interval
in the order of the other side, finds for each fragment how far its repeated windows reach.

Where more than ``block`` different fragments share an anchor they are dealt to blocks. Each block is
sorted by itself; windows that stand in several blocks are found by their hashes, of which a block
sends each once, so the work grows with the number of fragments and no two blocks meet.

Fragments and, across blocks, windows count as equal if two 64-bit hashes are (of the anchor's bytes
and of the whole). For k of them at one anchor a false match is less likely than k**2 / 2**65.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; repeated
rows are repeats of each other; matches never cross texts; only id and text are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import Scratch, release, require

GRAM = 32
#: Windows of one text are taken so many at a time, which bounds memory; places in such a part need the bits below.
PART, PLACE_BITS = 1 << 20, 22
BASE, UNBASE = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
SALT = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


class RollingHash:
    """Hashes of any substrings of one text, from sums of byte codes times powers of a base."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_powers["up"]) < n:
            size = 1 << n.bit_length()
            for name, b in (("up", BASE), ("down", UNBASE)):
                _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(size, b)], dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(SALT[data] * _powers["up"][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers["down"][start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    if width == 1 or n == 0:
        return x
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, fragment, lo, at, hi), part by part: anchors of a text; their windows start from lo to hi."""
    for start in range(0, len(text) - length + 1, PART):
        hash_, whole, *places = _part_anchors(text[start : start + PART + length - 1], length)
        yield hash_, whole, *[x + start for x in places]


def _part_anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    gram = min(GRAM, length)
    data = np.frombuffer(text, np.uint8)
    rolling = RollingHash(data)
    places = np.arange(len(data) - gram + 1)
    # inlined for all places: the sums' differences, brought to a common power
    grams = _mixed((rolling.sums[gram:] - rolling.sums[: len(places)]) * _powers["down"][: len(places)])
    keyed = grams & ~np.uint64((1 << PLACE_BITS) - 1) | places.astype(np.uint64)
    least = sliding_least(keyed, length - gram + 1)
    lo = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    hi = np.r_[lo[1:] - 1, len(least) - 1]
    at = (least[lo] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    whole = _mixed(rolling.of(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return grams[at].view(np.int64), whole.view(np.int64), lo, at, hi


def window_hashes(left: bytes, right: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows of a fragment; the hash covers the window and its place at the anchor."""
    data = np.frombuffer(left[::-1] + right, np.uint8)
    start = np.arange(max(0, len(data) - length + 1))
    place = len(left) - start
    return _mixed(RollingHash(data).of(start, start + length) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), start


# -- deep-shallow sorting ---------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    lo, hi = start, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    step = 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """A trie that keeps branching depths and branch bytes only; a text is read once on insertion.

    An inner node is [depth, {byte or -1 at the text's end: child}]; a leaf is the list of equal texts.
    """

    def __init__(self, texts: list[bytes], depth: int):
        self.texts, self.depth, self.root = texts, depth, None

    def insert(self, i: int) -> None:
        texts, text = self.texts, self.texts[i]
        if self.root is None:
            self.root = ("leaf", [i])
            return
        node, path = self.root, []
        while node[0] != "leaf":  # blind: branch bytes only
            path.append(node)
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = texts[node[1][0]]
        if text == other:
            node[1].append(i)
            return
        d = common_prefix(text, other, self.depth)
        mine, theirs = text[d] if d < len(text) else -1, other[d] if d < len(other) else -1
        parent, below = None, self.root
        for step in path:
            if step[0] > d:
                below = step
                break
            parent = step
            below = step[1].get(text[step[0]] if step[0] < len(text) else -1)
            if step[0] == d or below is None:
                step[1][mine] = ("leaf", [i])
                return
        inner = (d, {theirs: below, mine: ("leaf", [i])})
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = inner

    def ordered(self) -> Iterator[tuple[int, list[int]]]:
        """(common prefix with the class before, class of equal texts), in order; the first has -1."""
        stack, shared = [(self.root, -1)], -1
        while stack:
            node, shared = stack.pop()
            if node[0] == "leaf":
                yield shared, node[1]
            else:
                children = sorted(node[1])
                for k in range(len(children) - 1, -1, -1):
                    stack.append((node[1][children[k]], node[0] if k else shared))


def deep_shallow(texts: list[bytes], depth: int = 0, shallow: int = 24) -> list[tuple[int, list[int]]]:
    """Classes of equal texts in order, each with its common prefix with the one before (first: 0).

    ``depth`` bytes are known to be common. Multikey quicksort on words of eight bytes goes
    ``shallow`` bytes further; groups still undecided there are ordered by blind tries.
    """
    out: list[tuple[int, list[int]]] = []
    work = [(list(range(len(texts))), depth)]
    while work:
        group, d = work.pop()
        if len(group) == 1:
            found = [(-1, group)]
        elif d >= depth + shallow:
            trie = BlindTrie(texts, d)
            for i in group:
                trie.insert(i)
            found = trie.ordered()
        else:
            pivot = texts[group[len(group) // 2]][d : d + 8]
            less, same, more = [], [], []
            for i in group:
                word = texts[i][d : d + 8]
                (same if word == pivot else less if word < pivot else more).append(i)
            if more:
                work.append((more, d))
            # texts that end within this word are equal to the pivot as a whole: no deeper word differs
            work.append((same, d + 8 if len(pivot) == 8 else depth + shallow))
            if less:
                work.append((less, d))
            continue
        for shared, equal in found:
            if shared < 0:
                shared = common_prefix(texts[out[-1][1][0]], texts[equal[0]], depth) if out else 0
            out.append((shared, equal))
    return out


def reaches(lefts: list[bytes], rights: list[bytes], length: int, known: int) -> tuple[list[int], list[int]]:
    """(before, after): bytes around each anchor that repeated windows cover; both 0 if none.

    ``lefts`` are reversed: their common prefixes are common bytes before the anchor. ``known`` bytes
    after the anchor are common to all.
    """
    n = len(rights)
    before, after = [0] * n, [0] * n
    rank, at_rank = [0] * n, [0] * n
    place = 0
    left_lcp = [0] * n  # with the one of rank one less
    for shared, equal in deep_shallow(lefts):
        for k, i in enumerate(equal):
            rank[i], at_rank[place] = place, i
            left_lcp[place] = len(lefts[i]) if k else shared
            place += 1
    table = [left_lcp]  # least of 2**k neighbours, for common prefixes of any two ranks

    def left_common(a: int, b: int) -> int:
        if b == a + 1:
            return left_lcp[b]
        k = (b - a).bit_length() - 1
        while len(table) <= k:
            last, w = table[-1], 1 << len(table) - 1
            table.append([min(x, y) for x, y in zip(last, last[w:])])
        return min(table[k][a + 1], table[k][b - (1 << k) + 1])

    def meet(a: int, b: int, right: int) -> None:
        left = left_common(min(a, b), max(a, b))
        if left + right >= length:
            for i in (at_rank[a], at_rank[b]):
                before[i], after[i] = max(before[i], left), max(after[i], right)

    def join(a: list[int], b: list[int], right: int) -> list[int]:
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        fresh = []
        for r in small:
            k = bisect_left(big, r)
            if k:
                meet(big[k - 1], r, right)
            if k < len(big):
                meet(r, big[k], right)
            fresh.append(k)
        if len(small) * 8 > len(big):
            return sorted(big + small)
        for k, r in zip(reversed(fresh), reversed(small)):
            big.insert(k, r)
        return big

    stack: list[tuple[list[int], int]] = []  # (ranks of an interval, common prefix with the interval before it)
    for shared, equal in deep_shallow(rights, known):
        ranks = sorted(rank[i] for i in equal)
        for a, b in zip(ranks, ranks[1:]):
            meet(a, b, len(rights[equal[0]]))
        while len(stack) > 1 and stack[-1][1] > shared:
            top, r = stack.pop()
            below, r0 = stack.pop()
            stack.append((join(below, top, r), r0))
        stack.append((ranks, shared))
    while len(stack) > 1:
        top, r = stack.pop()
        below, r0 = stack.pop()
        stack.append((join(below, top, r), r0))
    return before, after


# -- the operator -----------------------------------------------------------------------------

ANCHORS = "row long, hash long, fragment long, lo long, at long, hi long"
MOST_ANCHORS, MOST_BYTES = 100_000, 8 << 20


def _bytes_of(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            cols = [np.concatenate([x[k] for x in held]).astype(np.int64) for k in range(5)]
            keys = np.repeat(np.array(owners, dtype=np.int64), [len(x[0]) for x in held])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *cols)], ["row", "hash", "fragment", "lo", "at", "hi"])

        held, owners, n = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_numpy().tolist(), b.column(1)):
                for found in anchors(_bytes_of(text), length):
                    held.append(found)
                    owners.append(key)
                    n += len(found[0])
                    if n > MOST_ANCHORS:
                        yield emit()
                        held, owners, n = [], [], 0
        if held:
            yield emit()

    return rows


FRAGMENTS = pa.schema([("hash", pa.int64()), ("fragment", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("kinds", pa.int64())])


def _cut_fragments(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1)):
                data = _bytes_of(text)
                for w in wanted.as_py():
                    out.append((w["hash"], w["fragment"], data[w["lo"] : w["at"]][::-1], data[w["at"] : w["hi"] + length], w["kinds"]))
                    size += w["hi"] + length - w["lo"]
                    if size > MOST_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FRAGMENTS)], schema=FRAGMENTS)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FRAGMENTS)], schema=FRAGMENTS)

    return cut


REACH = "hash long, fragment long, before long, after long"


def _reach_of(t: pa.Table, length: int) -> tuple[list[bytes], list[bytes], list[int], list[int]]:
    lefts, rights = t["left"].to_pylist(), t["right"].to_pylist()
    known = min(GRAM, length)
    if len({r[:known] for r in rights}) > 1:  # hashes collided: compare from the start
        known = 0
    return lefts, rights, *(reaches(lefts, rights, length, known) if lefts else ([], []))


def _resolve(length: int):
    def resolve(t: pa.Table) -> pa.Table:
        _, _, before, after = _reach_of(t, length)
        return pa.table({"hash": t["hash"], "fragment": t["fragment"], "before": pa.array(before, pa.int64()), "after": pa.array(after, pa.int64())})

    return resolve


def _resolve_block(length: int):
    def resolve(t: pa.Table, elsewhere: pa.Table) -> pa.Table:
        """The same for a block, with the windows that other blocks hold as well."""
        lefts, rights, before, after = _reach_of(t, length)
        known = np.unique(elsewhere["window"].to_numpy())
        for i, (left, right) in enumerate(zip(lefts, rights)):
            windows, start = window_hashes(left, right, length)
            found = start[np.isin(windows, known)]
            if len(found):
                before[i], after[i] = max(before[i], len(left) - int(found[0])), max(after[i], int(found[-1]) + length - len(left))
        return pa.table({"hash": t["hash"], "fragment": t["fragment"], "before": pa.array(before, pa.int64()), "after": pa.array(after, pa.int64())})

    return resolve


def _windows(length: int):
    def windows(key: tuple, t: pa.Table) -> pa.Table:
        """The distinct windows of a block of fragments."""
        found = np.unique(np.concatenate([window_hashes(a.as_py(), b.as_py(), length)[0] for a, b in zip(t["left"], t["right"])]))
        return pa.table({"hash": pa.array([key[0].as_py()] * len(found), pa.int64()), "own": pa.array([key[1].as_py()] * len(found), pa.int32()), "window": pa.array(found, pa.int64())})

    return windows


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, spans) of spans in order of row and start; of a row only its merged spans are held."""
    row, spans, out, size = None, [], [], 0

    def emit() -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch({"row": pa.array([r for r, _ in out], pa.int64()), "spans": pa.array([[{"start": s, "end": e} for s, e in x] for _, x in out], kind)})

    for b in batches:
        for r, s, e in zip(*[c.to_numpy().tolist() for c in b.columns]):
            if r != row:
                if row is not None:
                    out.append((row, spans))
                    size += len(spans)
                    if size > MOST_ANCHORS:
                        yield emit()
                        out, size = [], 0
                row, spans = r, [[s, e]]
            elif s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
    if row is not None:
        out.append((row, spans))
        yield emit()


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int, block: int = 4096) -> DataFrame:
    """(row, spans): stretches [start, end) of each text's bytes that repeated windows cover, apart and in order.

    ``docs`` has (row, text), with row a key of the id and text.
    """
    spark = docs.sparkSession
    found = scratch.save(docs.mapInArrow(_anchor_rows(length), ANCHORS), "anchors")
    one = F.min(F.struct("row", "lo", "at", "hi")).alias("one")
    classes = found.groupBy("hash", "fragment").agg(F.count(F.lit(1)).alias("c"), one).select("hash", "fragment", "c", "one.*").persist(StorageLevel.DISK_ONLY)
    held = classes.groupBy("hash").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1").select("hash", "kinds")
    shared = scratch.save_few(classes.join(held, "hash"), "shared")
    classes.unpersist()
    release(spark)
    compared = shared.where("kinds > 1").select("row", F.struct("hash", "fragment", "lo", "at", "hi", "kinds").alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    fragments = docs.join(compared, "row").dropDuplicates(["row"]).select("text", "wanted").mapInArrow(_cut_fragments(length), "hash long, fragment long, left binary, right binary, kinds long")
    crowded = shared.where(F.col("kinds") > block).limit(1).count()
    if crowded:  # else they are read once, and not written
        fragments = scratch.save(fragments, "fragments")
        release(spark)
    few = fragments.where(F.col("kinds") <= block).select("hash", "fragment", "left", "right")
    sorted_ = few.groupBy("hash").applyInArrow(_resolve(length), REACH)
    if crowded:
        many = fragments.where(F.col("kinds") > block).withColumn("own", F.pmod(F.xxhash64("fragment"), F.ceil(F.col("kinds") / block)).cast("int"))
        windows = scratch.save(many.groupBy("hash", "own").applyInArrow(_windows(length), "hash long, own int, window long"), "windows")
        several = windows.groupBy("hash", "window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash", "window")
        elsewhere = windows.join(several, ["hash", "window"]).select("hash", "own", "window")
        blocks = many.select("hash", "fragment", "left", "right", "own").groupBy("hash", "own").cogroup(elsewhere.groupBy("hash", "own")).applyInArrow(_resolve_block(length), REACH)
        sorted_ = sorted_.unionByName(blocks)
    whole = shared.where("c > 1").select("hash", "fragment")
    partial = sorted_.where("after > 0").join(whole, ["hash", "fragment"], "left_anti")
    reach = scratch.save_few(partial.unionByName(whole.select("*", F.lit(1 << 60).alias("before"), F.lit(1 << 60).alias("after"))), "reach")
    for name in ("shared", "fragments", "windows"):
        scratch.drop(name)
    release(spark)
    start, end = F.greatest(F.col("lo"), F.col("at") - F.col("before")), F.least(F.col("hi") + length, F.col("at") + F.col("after"))
    spans = found.join(reach, ["hash", "fragment"]).select("row", start.alias("start"), end.alias("end"))
    spans = scratch.save(spans.repartition("row").sortWithinPartitions("row", "start").mapInArrow(_merged, "row long, spans array<struct<start:long,end:long>>"), "spans")
    for name in ("anchors", "reach"):
        scratch.drop(name)
    release(spark)
    return spans


def with_spans(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans): spans are the [start, end) byte stretches to remove, null if there are none."""
    docs = require(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("id", "text"))
    spans = repeated_spans(docs.where(F.octet_length("text") >= length).select("row", "text"), Scratch(df.sparkSession, "suffixes"), length)
    return docs.join(spans, "row", "left").select("id", "text", "spans")


def _kept_parts(data: bytes, spans: list[dict]) -> Iterator[bytes]:
    at = 0
    for x in spans:
        yield data[at : x["start"]]
        at = x["end"]
    yield data[at:]


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), and with ``with_kept`` the remaining bytes as ``kept``."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_kept]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, rows = 0, 0, []
            for r, (text, found) in enumerate(zip(b.column(1), b.column(2))):
                data, spans, digest = _bytes_of(text), found.as_py() or [], hashlib.sha256()
                parts = list(_kept_parts(data, spans))
                for part in parts:
                    digest.update(part)
                left = sum(map(len, parts))
                rows.append((len(data), len(data) - left, len(spans), digest.hexdigest(), *[b"".join(parts)] * with_kept))
                size += left * with_kept
                if size > MOST_BYTES or r + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["id", *names])
                    first, size, rows = r + 1, 0, []

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return with_spans(df, length, id_col, text_col).mapInArrow(remove, schema).withColumnRenamed("id", id_col)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_repeats(df: DataFrame, length: int, least_words: int = 0, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with repeated stretches cut from their texts.

    A stretch goes if repeated strings of ``length`` bytes cover it and it holds ``least_words`` words or
    more; a character cut in two goes whole. Null texts stay null; rows of equal values count as copies of
    each other; other columns are kept as they are, whatever their names.
    """
    rows = df.select(F.struct(*[c for c in df.columns if c != text_col]).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, texts = 0, 0, []
            for r, (text, found) in enumerate(zip(b.column(1), b.column(2))):
                if found.is_valid:
                    data = _bytes_of(text)
                    spans = [x for x in found.as_py() if len(WORD.findall(data, x["start"], x["end"])) >= least_words]
                    texts.append("".join(p.decode("utf-8", "ignore") for p in _kept_parts(data, spans)))
                else:
                    texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > MOST_BYTES or r + 1 == len(b):
                    yield pa.record_batch({"id": b.column(0).slice(first, len(texts)), "text": pa.array(texts, pa.string())})
                    first, size, texts = r + 1, 0, []

    kept = with_spans(rows, length, "id", "text").mapInArrow(cut, f"id {kind}, text string")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in df.columns])
