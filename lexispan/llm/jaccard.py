"""Operator 2: n-gram Jaccard join with prefix filters under several global token orders.

1. Texts become sets of distinct word shingles, kept as 64-bit hashes; documents with equal sets
   form one class. Each set's tokens go, as compact byte runs, to buckets of the token space; there
   every token's document frequency (over classes) is counted.
2. A set of which less than the threshold's share of tokens occurs in another set has no partner. The
   others get prefixes under three orders of all tokens: rarest first with ties by token, rarest
   first with ties by a mixed token, and tokens of one set only last with the rest by another mix.
   Under each order two linked sets share a token of their prefixes.
3. Candidates share a token of the first prefix and are of matching size; those whose prefixes under
   the other orders share nothing are dropped; the rest are verified on whole sets. To find classes,
   not all pairs of a group are needed: each round compares every set with one leader per token,
   unless they are already connected. What stays unconnected after some rounds is compared in full:
   pair by pair for tokens of few sets, else block by block, without emitting pairs.

Defined cases: null or wordless texts have no shingles and no links, and are components of their own;
texts of fewer words than a shingle are one shingle; repeated rows are linked to each other; only id
and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import Scratch, components, release, require

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKEN_BITS = 40
HEAD = np.dtype([("key", "<i8"), ("n", "<u4"), ("run", "<u4")])
DOC = np.dtype([("row", "<u4"), ("key", "<i8"), ("n", "<u4")])
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(salt)) * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased."""
    found = WORD.findall((text or "").encode("utf-8", "replace").lower())
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    size = min(words, len(h))
    a = h[: len(h) - size + 1] + np.uint64(size)
    for k in range(1, size):
        a = mix(a, k) + h[k : len(h) - size + 1 + k]
    return np.unique(mix(a, 99))


def pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes | pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(flat), 8), dtype=np.uint8)
    out[:, :5] = flat
    return out.view("<u8").ravel()


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least intersection of a set of size n with any set it links to."""
    return -(-n * percent // 100)


class _Batch:
    """Sets on their way out: one row of byte runs for each bucket, and the documents themselves."""

    def __init__(self, bits: int):
        self.bits, self.sets, self.keys, self.size = bits, [], {}, 0

    def add(self, u: np.ndarray) -> int:
        key = xxhash.xxh64_intdigest(u.tobytes()) - (1 << 63)
        if key not in self.keys:  # copies count once
            self.keys[key] = len(self.sets)
            self.sets.append(u)
            self.size += len(u)
        return key

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.sets:
            return
        sizes = np.array([len(u) for u in self.sets])
        tokens = np.concatenate(self.sets)
        bucket = (tokens >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.int32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(bucket, kind="stable")
        tokens, owner = tokens[order] >> np.uint64(64 - self.bits - TOKEN_BITS) & np.uint64((1 << TOKEN_BITS) - 1), owner[order]
        bucket = bucket[order]
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        keys = np.array(list(self.keys), dtype=np.int64)
        for lo, hi in zip(begins, np.r_[begins[1:], len(bucket)]):
            who, runs = np.unique(owner[lo:hi], return_counts=True)  # owners stand in order
            heads = np.empty(len(who), dtype=HEAD)
            heads["key"], heads["n"], heads["run"] = keys[who], sizes[who], runs
            yield int(bucket[lo]), heads.tobytes(), pack40(tokens[lo:hi])


ROUTED = "bucket int, heads binary, tokens binary, id {kind}, key long, n long"
COUNTED = "part int, heads binary, tokens binary, df binary, id {kind}, key long, n long"


def _route(bits: int, words: int, most: int = 2_000_000):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch: _Batch) -> pa.RecordBatch:
            rows = list(batch.rows())
            nothing = [None] * len(rows)
            return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "heads": pa.array([r[1] for r in rows], pa.binary()), "tokens": pa.array([r[2] for r in rows], pa.binary()), "id": pa.array(nothing, id_type), "key": pa.array(nothing, pa.int64()), "n": pa.array(nothing, pa.int64())})

        for b in batches:
            id_type, batch, keys, sizes = b.column(0).type, _Batch(bits), [], []
            for text in b.column(1).to_pylist():
                u = shingles(text, words)
                keys.append(batch.add(u) if len(u) else None)
                sizes.append(len(u))
                if batch.size > most:
                    yield emit(batch)
                    batch = _Batch(bits)
            yield emit(batch)
            # the documents pass through the same shuffle, dealt evenly
            deal = pa.array(-1 - np.arange(len(b)) % (1 << bits), pa.int32())
            nothing = pa.nulls(len(b), pa.binary())
            yield pa.record_batch({"bucket": deal, "heads": nothing, "tokens": nothing, "id": b.column(0), "key": pa.array(keys, pa.int64()), "n": pa.array(sizes, pa.int64())})

    return route


SLICES = 16


def _often(tokens: np.ndarray, owner: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, owner, df) of the tokens of several classes, in order of token and class."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    again = tokens[1:] == tokens[:-1]
    often = np.zeros(len(tokens), dtype=bool)
    often[1:] |= again
    often[:-1] |= again
    tokens, owner = tokens[often], owner[often]
    keys = heads["key"][owner]
    order = np.lexsort((keys, tokens))
    tokens, keys, owner = tokens[order], keys[order], owner[order]
    first = np.ones(len(tokens), dtype=bool)  # a class met in several batches counts once
    first[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, owner = tokens[first], owner[first]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.r_[starts, len(tokens)])
    df = np.repeat(times, times)
    kept = df > 1
    return tokens[kept], owner[kept], np.minimum(df[kept], 65535).astype("<u2")


def _count(bits: int, parts: int):
    def count(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            nothing = pa.nulls(t.num_rows, pa.binary())
            return pa.table({"part": pa.nulls(t.num_rows, pa.int32()), "heads": nothing, "tokens": nothing, "df": nothing, "id": t["id"], "key": t["key"], "n": t["n"]})
        heads = np.concatenate([np.frombuffer(x.as_py(), HEAD) for x in t["heads"]])
        held = sum(len(x.as_buffer()) for x in t["tokens"]) // 5
        tokens, at = np.empty(held, np.uint64), 0
        for x in t["tokens"]:
            some = unpack40(x.as_buffer())
            tokens[at : at + len(some)] = some
            at += len(some)
        owner = np.repeat(np.arange(len(heads), dtype=np.int32), heads["run"])
        slices = [_often(tokens[at], owner[at], heads) for k in range(SLICES) if len(at := np.flatnonzero(tokens >> np.uint64(TOKEN_BITS - 4) == k))]
        ranked, owner, df = (np.concatenate([x[k] for x in slices]) for k in range(3))
        keys = heads["key"][owner]
        part = (mix(keys, 7) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((ranked, keys, part))
        ranked, keys, owner, df, part = ranked[order], keys[order], owner[order], df[order], part[order]
        rows = []
        ends = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            lo, hi = ends[p], ends[p + 1]
            if lo < hi:
                begin = np.flatnonzero(np.r_[True, keys[lo + 1 : hi] != keys[lo : hi - 1]]) + lo
                runs = np.empty(len(begin), dtype=HEAD)
                runs["key"], runs["n"], runs["run"] = keys[begin], heads["n"][owner[begin]], np.diff(np.r_[begin, hi])
                rows.append((p, runs.tobytes(), pack40(ranked[lo:hi]) + bucket.to_bytes(4, "little"), df[lo:hi].tobytes()))
        none = [None] * len(rows)
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "heads": pa.array([r[1] for r in rows], pa.binary()), "tokens": pa.array([r[2] for r in rows], pa.binary()), "df": pa.array([r[3] for r in rows], pa.binary()), "id": pa.array(none, t.schema.field("id").type), "key": pa.array(none, pa.int64()), "n": pa.array(none, pa.int64())})

    return count


def _gather(percent: int):
    def gather(t: pa.Table) -> pa.Table:
        heads, tokens, df = [], [], []
        for h, x, d in zip(t["heads"].to_pylist(), t["tokens"].to_pylist(), t["df"].to_pylist()):
            heads.append(np.frombuffer(h, HEAD))
            tokens.append(unpack40(x[:-4]) | np.uint64(int.from_bytes(x[-4:], "little") << TOKEN_BITS))
            df.append(np.frombuffer(d, "<u2"))
        heads, tokens, df = np.concatenate(heads), np.concatenate(tokens), np.concatenate(df)
        keys, sizes = np.repeat(heads["key"], heads["run"]), np.repeat(heads["n"].astype(np.int64), heads["run"])
        order = np.lexsort((tokens, keys))
        keys, sizes, tokens, df = keys[order], sizes[order], tokens[order], df[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out = {"key": [], "n": [], "tokens": [], "first": [], "second": [], "third": []}
        for lo, hi in zip(begin, np.r_[begin[1:], len(keys)]):
            n, shared = int(sizes[lo]), int(hi - lo)
            least = needed(n, percent)
            if shared < least:
                continue
            x, f, prefix = tokens[lo:hi], df[lo:hi], n - least + 1
            short = prefix - (n - shared)  # tokens of this set only come first
            out["key"].append(int(keys[lo]))
            out["n"].append(n)
            out["tokens"].append(x.astype(np.int64))
            out["first"].append(x[np.lexsort((x, f))[:short]].astype(np.int64))
            out["second"].append(x[np.lexsort((mix(x, 11), f))[:short]].astype(np.int64))
            out["third"].append(x[np.argsort(mix(x, 13), kind="stable")[:prefix]].astype(np.int64))
        longs = pa.list_(pa.int64())
        return pa.table({k: pa.array(v, longs if k in ("tokens", "first", "second", "third") else pa.int64()) for k, v in out.items()})

    return gather


def _sizes_match(a: str | Column, b: str | Column, percent: int) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def shingle_classes(df: DataFrame, scratch: Scratch, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, n) and the sets that may have partners (key, n, tokens and prefixes)."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    docs = require(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(64 - TOKEN_BITS, max(5, int(size / 7 / 4_000_000).bit_length()))  # about four million tokens to a bucket
    parts = 1 << bits
    routed = docs.mapInArrow(_route(bits, words), ROUTED.format(kind=kind))
    counted = scratch.save(routed.groupBy("bucket").applyInArrow(_count(bits, parts), COUNTED.format(kind=kind)), "counted")
    del routed
    release(spark)
    documents = counted.where("part is null").select("id", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    sets = counted.where("part is not null").groupBy("part").applyInArrow(_gather(percent), "key long, n long, tokens array<long>, first array<long>, second array<long>, third array<long>")
    return documents, scratch.save(sets, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those of enough similarity; whole sets are sent only for those that pass the other orders' filters."""
    side = lambda s, *names: sets.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in names])
    near = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b").where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    both = near.select("a", "b").join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _compare_blocks(percent: int, slab: int = 4096):
    def compare(key: tuple, t: pa.Table) -> pa.Table:
        """Links between sets of two blocks, one for each two labels; intersections by products of incidence."""
        first, second, chunk = key[1].as_py(), key[2].as_py(), t["chunk"].to_numpy()
        labels, sizes = t["label"].to_numpy(), t["n"].to_numpy()
        lists = t["tokens"].combine_chunks()
        tokens = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
        met = times[column] > 1  # a token of one set adds to no intersection
        column, owner = np.unique(column[met], return_inverse=True)[1], owner[met]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        left, right = np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        wide = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, wide, slab):
            lo, hi = np.searchsorted(column, [at, at + slab])
            m = np.zeros((t.num_rows, min(slab, wide - at)), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            common += m[left] @ m[right].T
        total = sizes[left][:, None] + sizes[right][None]
        linked = (100 * common.astype(np.int64) >= percent * (total - common.astype(np.int64))) & (labels[left][:, None] != labels[right][None])
        a, b = np.nonzero(linked)
        ends = np.unique(np.stack([labels[left][a], labels[right][b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return compare


def block_links(open_: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, block: int = 512) -> DataFrame:
    """(a, b): labels that have a link between them, for tokens of many sets that are not yet one component.

    Such sets form families by the tokens they share. In each, sets outside of its largest component are
    strays; links can only join a stray to a stray or to another set. Strays and others are dealt to blocks, and each block
    of strays meets each block of either in one task, so that no pairs are emitted: a set is sent once for
    each block of strays, and a stray once for each block.
    """
    member = scratch.save(open_.select("key", "label", "main").distinct(), "family-members")
    families = components(member.where("label <> main").select(F.col("label").alias("a"), F.col("main").alias("b")), scratch, "families")
    member = member.select("key", "label").distinct().join(families.select(F.col("node").alias("label"), F.col("label").alias("family")), "label")
    sizes = scratch.save(member.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c")), "family-labels")
    in_blocks = lambda c: F.ceil(c / block).cast("int")
    held = sizes.groupBy("family").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all")).select("family", F.col("most.label").alias("main"), in_blocks(F.col("all") - F.col("most.c")).alias("stray_blocks"), in_blocks(F.col("most.c")).alias("main_blocks"))
    held = scratch.save(held, "families")
    stray = F.col("label") != F.col("main")
    own = F.when(stray, F.pmod(F.xxhash64("key"), "stray_blocks")).otherwise(F.col("stray_blocks") + F.pmod(F.xxhash64("key"), "main_blocks"))
    others = F.when(stray, F.col("stray_blocks") + F.col("main_blocks")).otherwise(F.col("stray_blocks"))
    dealt = member.join(held, "family").join(sets.select("key", "n", "tokens"), "key").withColumn("chunk", own.cast("int"))
    sent = dealt.select("family", "label", "n", "tokens", "chunk", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    sent = sent.select("family", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "label", "n", "tokens", "chunk")
    return scratch.save(sent.groupBy("family", "first", "second").applyInArrow(_compare_blocks(percent), "a long, b long"), "block-links")


def linked_classes(sets: DataFrame, scratch: Scratch, percent: int, rounds: int = 3, few: int = 32) -> DataFrame:
    """(key, label): sets that are linked, directly or by others, have one label."""
    labels = scratch.save(sets.select("key", F.col("key").alias("label")), "labels0")
    postings = scratch.save(sets.select("key", "n", F.explode("first").alias("token")), "postings")
    lone = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    postings = scratch.save(postings.join(lone, "token", "left_semi"), "shared")
    tried: DataFrame | None = None
    for k in range(rounds + 1):
        here = postings.join(labels, "key")
        if k < rounds:
            lead = here.groupBy("token").agg(F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("at"), "key", "n", "label")).alias("lead"))
            met = here.join(lead, "token").where((F.col("label") != F.col("lead.label")) & _sizes_match("n", "lead.n", percent)).select("key", F.col("lead.key").alias("other"))
        else:  # in full: what is not of a token's largest component, against all of other components
            held = here.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
            most = held.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("held")).where("labels > 1")
            most = scratch.save(most.select("token", F.col("most.label").alias("main"), "held"), "open")
            open_ = here.join(most, "token")
            blocked = block_links(open_.where(F.col("held") > few), sets, scratch, percent)
            open_ = open_.where(F.col("held") <= few)
            strays = open_.where("label <> main").select("token", F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"))
            met = open_.join(strays, "token").where((F.col("label") != F.col("other_label")) & ((F.col("label") == F.col("main")) | (F.col("key") < F.col("other"))) & _sizes_match("n", "other_n", percent)).select("key", "other")
        pairs = met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, f"pairs{k}")
        if k < rounds and not pairs.limit(1).count():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = scratch.save(verified(pairs, sets, percent), f"edges{k}")
        by_label = edges.join(labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        by_label = by_label.select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = scratch.save(by_label if k < rounds else by_label.unionByName(blocked), f"joined{k}")
        if joined.limit(1).count():
            merged = components(joined, scratch, f"merge{k}").select(F.col("node").alias("label"), F.col("label").alias("low"))
            labels = scratch.save(labels.join(merged, "label", "left").select("key", F.coalesce("low", "label").alias("label")), f"labels{k + 1}")
        release(sets.sparkSession)
    for name in ("postings", "shared", "open", "family-members", *[f"{x}{k}" for x in ("pairs", "edges", "joined") for k in range(rounds + 1)]):
        scratch.drop(name)  # labels are a table of their own
    return labels


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each document; component_id is the smallest id reachable."""
    scratch = Scratch(df.sparkSession, "jaccard")
    documents, sets = shingle_classes(df, scratch, percent, words, id_col, text_col)
    labels = linked_classes(sets, scratch, percent)
    classes = documents.where("n > 0").groupBy("key").agg(F.min("id").alias("least"))
    labelled = classes.join(labels, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    labelled = scratch.save(labelled, "labelled")
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = labelled.join(lowest, "label").select("key", "component_id")
    found = documents.where("n > 0").join(by_key, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = documents.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(alone).withColumnRenamed("id", id_col)
