"""Operators 5 and 10: token counts by prefix tables, streaming encoding and decoding.

Defined cases: a null text counts as empty; an empty text has no tokens; repeated rows give repeated
rows; columns other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lexispan.llm.bpe import Encoder, PrefixCounter, Utf8Machine, merge_table
from lexispan.llm.common import require


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(merge_table(path))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(merge_table(path))


def token_counts(df: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, by the prefix table of operator 5."""
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.total(t) for t in texts]
            yield pa.record_batch({"id": b.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    out = require(df, id_col, text_col).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def truncate_to_budget(df: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens): the longest prefix of each text that has at most ``budget`` tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                index = counter.index(t or "")
                n = index.longest_prefix(budget)
                texts.append((t or "")[:n])
                counts.append(index.count(n))
            yield pa.record_batch({"id": b.column(0), "text": pa.array(texts, pa.string()), "n_tokens": pa.array(counts, pa.int64())})

    return require(df, id_col, text_col).mapInArrow(cut, f"id {kind}, text string, n_tokens long").withColumnRenamed("id", id_col)


def prefix_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts, counts): pre-token starts in characters and the tokens before each; last the text's end."""
    kind = df.schema[id_col].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            made = [counter.index(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch({"id": b.column(0), "starts": pa.array([[*x.starts, len(x.text)] for x in made], pa.list_(pa.int64())), "counts": pa.array([x.sums for x in made], pa.list_(pa.int64()))})

    return require(df, id_col, text_col).mapInArrow(index, f"id {kind}, starts array<long>, counts array<long>").withColumnRenamed("id", id_col)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text, by the streaming transducer of operator 10."""
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            yield pa.record_batch({"id": b.column(0), "ids": pa.array([encoder.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))})

    return require(df, id_col, text_col).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids, by the byte-to-text state machine; null: empty."""
    from lexispan.llm.bpe import decode

    kind = df.schema[id_col].dataType.simpleString()

    def to_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = merge_table(tokenizer)
        for b in batches:
            yield pa.record_batch({"id": b.column(0), "text": pa.array(["".join(decode(t, ids or ())) for ids in b.column(1).to_pylist()], pa.string())})

    return require(df, id_col, ids_col).mapInArrow(to_text, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, as a stream.

    Tokens go from the transducer to the decoder in runs; neither the ids nor the text are held whole.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        of = encoder.table.bytes_of
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids_hash, text_hash, machine, n = hashlib.sha256(), hashlib.sha256(), Utf8Machine(), 0
                for found, groups in encoder.parts(t or ""):
                    part = ",".join(found).encode()
                    if part:
                        ids_hash.update(b"," + part if n else part)
                        n += part.count(b",") + 1
                    text_hash.update(machine.feed(b"".join(map(of.__getitem__, chain.from_iterable(groups)))).encode())
                text_hash.update(machine.finish().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch({"id": b.column(0), "n_tokens": pa.array(cols[0], pa.int64()), "ids_sha256": pa.array(cols[1], pa.string()), "decoded_sha256": pa.array(cols[2], pa.string())})

    out = require(df, id_col, text_col).mapInArrow(digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
