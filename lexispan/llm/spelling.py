"""Operator 11: groups of spelling variants, by Levenshtein automata over broadcast trie shards.

Words are counted; those of ``min_length`` code points and ``min_count`` occurrences or more are the
vocabulary. Ranges of it, in order, become compact tries of at most ``SHARD_WORDS`` words. Tries are broadcast
in rounds of at most ``ROUND_BYTES``; in each round every word's automaton of distance one meets every
trie of the round: depth-first along the word itself, and at each node once through each edge that deletes, replaces or
inserts one code point, after which the rest of the word has to follow. A range that shares no
beginning with the word is left at its root. Accepting nodes are neighbours. A word's neighbours of a round are reduced
where they are found to their number and the best of them, rounds are reduced by word, and roots are
found by doubling pointers along the forms, of which each at least doubles the count.

What is broadcast at a time does not grow with the vocabulary, the number of rounds does. Frequent words
are counted in each task before they are shuffled; pointers to a root that many words share are joined
without grouping, so Spark can split them.

Defined cases: null text has no words; a null id counts as an empty one in the rule that changes words; a word
without neighbours is its own root; equal counts go by code-point order; repeated rows count again; texts of
any length are read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import Scratch, require

# What stands between words, and which letters are lower-cased.
GAPS = r"[^a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many runs of a text loses a code point, by a hash of id and run.
CHANGED = 97

SHARD_WORDS = 1 << 17
ROUND_BYTES = 32 << 20


class Trie:
    """A sorted range of words. Edges lie in breadth-first order: edge e leads to node e + 1, and the edges of
    node v are ``labels[first[v]:first[v + 1]]``; ``accepts[v]`` is 0 or 1 + the place of its count in ``counts``."""

    def __init__(self, labels: str, first: array, accepts: array, counts: array):
        self.labels, self.first, self.accepts, self.counts = labels, first, accepts, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        labels, first, accepts = [], array("I"), array("I")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(labels))
                accepted = len(words[lo]) == depth if lo < hi else False
                accepts.append(lo + 1 if accepted else 0)
                lo += accepted
                while lo < hi:
                    label = words[lo][depth]
                    end = lo + 1
                    if words[hi - 1][depth] == label:
                        end = hi
                    else:
                        while words[end][depth] == label:
                            end += 1
                    labels.append(label)
                    below.append((lo, end))
                    lo = end
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("".join(labels), first, accepts, array("q", counts))

    def to_row(self) -> dict[str, bytes]:
        return {"labels": self.labels.encode(), "first": self.first.tobytes(), "accepts": self.accepts.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> Trie:
        held = [array(kind) for kind in "IIq"]
        for a, name in zip(held, ("first", "accepts", "counts")):
            a.frombytes(row[name])
        return cls(row["labels"].decode(), *held)

    def count(self, v: int, rest: str) -> int:
        """The count of the word that ``rest`` ends from node ``v`` on; 0 if there is none."""
        find, first = self.labels.find, self.first
        for c in rest:
            v = find(c, first[v], first[v + 1]) + 1
            if not v:
                return 0
        at = self.accepts[v]
        return self.counts[at - 1] if at else 0

    def near(self, word: str) -> list[tuple[int, str]]:
        """(count, word) of the words at a distance of exactly one."""
        labels, first, count, found = self.labels, self.first, self.count, []
        find, n, v = labels.find, len(word), 0
        for i in range(n + 1):
            here, lo, hi = word[i : i + 1], first[v], first[v + 1]
            rest = word[i + 1 :]
            if here and (i == 0 or here != word[i - 1]):  # of equal letters in a row one is deleted
                if c := count(v, rest):
                    found.append((c, word[:i] + rest))
            follows = rest[:1]
            for e in range(lo, hi):
                label = labels[e]
                if label == here:  # inserting it is the same behind it
                    continue
                a, z = first[e + 1], first[e + 2]
                if here:
                    if not follows or find(follows, a, z) >= 0:
                        if c := count(e + 1, rest):
                            found.append((c, word[:i] + label + rest))
                    if find(here, a, z) >= 0 and (c := count(e + 1, word[i:])):
                        found.append((c, word[:i] + label + word[i:]))
                elif c := count(e + 1, ""):
                    found.append((c, word + label))
            if not here:
                break
            v = find(here, lo, hi) + 1
            if not v:
                break
        return found


SHARDS = "low string, size long, labels binary, first binary, accepts binary, counts binary"
NEAR = "word string, n_near long, best_n long, best string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _build(shard_words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []

        def shard() -> pa.RecordBatch:
            row = Trie.of(words[:shard_words], counts[:shard_words]).to_row()
            row |= {"low": words[0], "size": sum(map(len, row.values()))}
            del words[:shard_words], counts[:shard_words]
            return pa.RecordBatch.from_pylist([row], _arrow(SHARDS))

        for b in batches:
            words += b.column("word").to_pylist()
            counts += b.column("n").to_pylist()
            while len(words) >= shard_words:
                yield shard()
        if words:
            yield shard()

    return build


def _meet(held):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.from_row(row) for row in held.value]
        for b in batches:
            out = []
            for word in b.column("word").to_pylist():
                found = [x for trie in tries for x in trie.near(word)]
                if found:
                    n, best = min((-n, near) for n, near in found)
                    out.append({"word": word, "n_near": len(found), "best_n": -n, "best": best})
            yield pa.RecordBatch.from_pylist(out, _arrow(NEAR))

    return meet


def changed_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = CHANGED) -> DataFrame:
    """(word) of every run of letters of every text, lower-cased; one in ``every`` has lost a code point."""
    runs = require(df, id_col, text_col).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode_outer(F.split(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), GAPS)).alias("run")).where("run <> ''")
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at: Column = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def spelling_groups(words: DataFrame, min_length: int = 5, min_count: int = 3, shard_words: int | None = None, round_bytes: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``words`` (word)."""
    spark, scratch = words.sparkSession, Scratch(words.sparkSession, "spelling")
    shard_words, round_bytes = shard_words or SHARD_WORDS, round_bytes or ROUND_BYTES
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    vocabulary = scratch.save(counted, "vocabulary")
    ranges = max(1, -(-vocabulary.count() // shard_words))
    tries = scratch.save(vocabulary.repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(_build(shard_words), SHARDS), "tries")

    rounds: list[list[str]] = []
    size = 0
    for low, more in tries.select("low", "size").orderBy("low").collect():  # a row for each shard of many words
        if not rounds or size + more > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(low)
        size += more
    cores = spark.sparkContext.defaultParallelism
    dealt = vocabulary.select("word").repartition(max(cores * 4, ranges))
    found = None
    for k, lows in enumerate(rounds):
        rows = [r.asDict() for r in tries.where(F.col("low").between(lows[0], lows[-1])).drop("low", "size").collect()]
        held = spark.sparkContext.broadcast(rows)
        part = scratch.save(dealt.mapInArrow(_meet(held), NEAR), f"near{k}")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vocabulary.select("word", *[F.lit(None).cast("string").alias(c) for c in ("form", "root")], "n", *[F.lit(None).cast("long").alias(c) for c in ("n_near", "form_n")])
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    form = lambda c: F.when(-F.col("best.n") >= 2 * F.col("n"), c)
    judged = vocabulary.join(near, "word", "left").select("word", form(F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(-F.col("best.n")).cast("long").alias("form_n"))
    judged = scratch.save(judged, "judged")

    # roots: pointers along the forms, doubled until none moves
    pointers, k = scratch.save(judged.where("form IS NOT NULL").select("word", F.col("form").alias("to"), F.lit(True).alias("open")), "pointers0"), 0
    while pointers.where("open").limit(1).count():
        steps = pointers.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        moved = pointers.where("open").join(steps, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("open"))
        k += 1
        pointers = scratch.save(moved.unionByName(pointers.where("NOT open")), f"pointers{k}")
        scratch.drop(f"pointers{k - 1}")
    return judged.join(pointers.select("word", F.col("to").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
