"""Operator 9: vector best-fit packing of documents into sequences of bounded size.

Every bin has residual capacities for tokens, for documents and for attention cost (the sum of
squared piece lengths). Pieces go, longest first, to an open bin that can take them under every
capacity: the one of least weighted residual norm after placing, or of largest weighted dot-product.

Pieces are dealt to shards by a hash of their id, number, checksum and place in the input, so copies of one row are
dealt too; each shard is of a bounded number of documents and
packed by itself; it leaves at most a few bins part-filled.

Defined cases: a null id is an id as any other; a null text counts as empty and still has its closing id; a document longer than the
capacity is cut into full pieces, of which the first may be shorter; repeated rows are packed
separately; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.bpe import SPLIT, Encoder, merge_table
from lexispan.llm.common import require

PIECES = "piece int, start long, length long, ids_crc32 long"


PLAIN = 100_000


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """text -> uint32 ids; the rank-based library where ids are in merge order, else the file's own.

    The former runs out of stack on very long white space; a text of over ``PLAIN`` characters goes
    through the streaming encoder of operator 10, part by part.
    """
    table = merge_table(path)
    made = [table.ids[a + b] for a, b in table.rank]
    if made == sorted(made):
        import tiktoken

        own, long_ = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table.ids, special_tokens=table.special), Encoder(table, cache=50_000)

        def encode(text: str) -> np.ndarray:
            if len(text) <= PLAIN:
                return own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            parts = [np.fromiter(chain.from_iterable(groups), "<u4") for _, groups in long_.parts(text)]
            return np.concatenate(parts)

        return encode
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that takes what is over."""
    if n <= 0:
        return
    first = n % size or size
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by vector best-fit in order of falling length.

    ``rule`` is "norm" (least weighted norm of what stays free) or "dot" (largest weighted
    dot-product of demand and free capacity). A piece over a capacity by itself gets a bin of its own.
    """
    n = len(lengths)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    caps = np.array([tokens, documents, attention], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    free, ids, used, made = np.empty((3, 64)), np.empty(64, dtype=np.int64), 0, 0
    for k in np.argsort(-lengths, kind="stable"):
        size = float(lengths[k])
        need = np.array([size, 1.0, size * size])
        at = -1
        if used and size < tokens:
            f = free[:, :used]
            fits = (f[0] >= need[0]) & (f[1] >= need[1]) & (f[2] >= need[2])
            if fits.any():
                if rule == "norm":
                    left = (f - need[:, None]) / caps[:, None]
                    at = int(np.argmin(np.where(fits, (w[:, None] * left * left).sum(0), np.inf)))
                else:
                    at = int(np.argmax(np.where(fits, ((w * need / caps / caps)[:, None] * f).sum(0), -np.inf)))
        if at < 0:
            where[k], offset[k] = made, 0
            if size < tokens:
                if used == free.shape[1]:
                    free, ids = np.concatenate([free, np.empty_like(free)], axis=1), np.concatenate([ids, np.empty_like(ids)])
                free[:, used], ids[used] = caps - need, made
                used += 1
            made += 1
            continue
        where[k], offset[k] = ids[at], tokens - free[0, at]
        free[:, at] -= need
        if free[0, at] < 1 or free[1, at] < 1:  # closed: the last open bin takes its place
            used -= 1
            free[:, at], ids[at] = free[:, used], ids[used]
    return where, offset


#: Rows of one id and text are dealt to at most so many shards.
DEALT = 4096


def pack_documents(df: DataFrame, tokenizer: str, tokens: int = 2048, documents: int | None = None, attention: float | None = None, weights=(1.0, 1e-3, 1e-3), rule: str = "norm", closing_id: int = 0, shard_documents: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    documents, attention = documents or tokens, attention or float(tokens) ** 2
    kind = df.schema[id_col].dataType.simpleString()
    docs = require(df, id_col, text_col)
    shards = max(1, math.ceil(docs.select(id_col).count() / shard_documents))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = fast_encoder(tokenizer), np.array([closing_id], dtype="<u4")
        seen = 0
        for b in batches:
            row, number, start, length, crc = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([encode(t), closing]) if t else closing
                for k, (s, n) in enumerate(cut(len(ids), tokens)):
                    row.append(r)
                    number.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            deal = [(seen + r) % DEALT for r in row]
            seen += b.num_rows
            yield pa.record_batch({"id": b.column(0).take(pa.array(row, pa.int64())), "deal": pa.array(deal, pa.int32()), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(t["length"].to_numpy(), tokens, documents, attention, weights, rule)
        t = t.drop_columns(["shard"])
        return t.append_column("sequence_id", pa.array(where + (key[0].as_py() << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = docs.mapInArrow(pieces, f"id {kind}, deal int, {PIECES}")
    made = dealt.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "deal"), F.lit(shards)).cast("long")).drop("deal")
    out = made.groupBy("shard").applyInArrow(pack, f"id {kind}, {PIECES}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
