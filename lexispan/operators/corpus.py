"""Frames of a corpus: sentences with words, and annotated words.

``sentences``: id, sent_idx int (from 0, empty sentences counted), words array<string>, and meta
array<struct> once words are annotated. Spans are kept apart, see ``match``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions.text import document_length, document_text, py_slice, sentence_pieces, words_of


#: Words of more than one in so many are salted.
HEAVY = 2000
#: Tables of common words hold at most so many, of at most so many characters.
COMMON, COMMON_LENGTH = 1 << 17, 48
#: Places of a table of known words; of words that share one the most frequent is kept.
PLACES = 1 << 18


@dataclass(frozen=True)
class Corpus:
    """Sentences and the spans found in them. Matchers wait until the spans are asked for, or the sentences change, so
    those that follow each other share one pass over the words."""

    sentences: DataFrame | None = None
    held: DataFrame | None = None
    waiting: tuple = ()
    matchers: int = 0
    id_col: str = "doc_id"

    @property
    def spans(self) -> DataFrame | None:
        if not self.waiting:
            return self.held
        from lexispan.operators.match import match_all

        found = match_all(self.sentences, self.waiting, self.matchers - len(self.waiting), self.id_col)
        return found if self.held is None else self.held.unionByName(found, allowMissingColumns=True)

    def with_(self, **changes) -> Corpus:
        if "spans" in changes:
            changes |= {"held": changes.pop("spans"), "waiting": ()}
        elif "sentences" in changes and self.waiting:
            changes |= {"held": self.spans, "waiting": ()}
        return replace(self, **changes)

    def matching(self, kb, size: int, pre_filter) -> Corpus:
        return replace(self, waiting=(*self.waiting, (kb, size, pre_filter)), matchers=self.matchers + 1)


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sentence; documents without any give none."""
    pieces = df.select(id_col, F.posexplode(sentence_pieces(F.col(text_col))).alias("sent_idx", "piece"))
    return pieces.select(id_col, "sent_idx", words_of(F.col("piece")).alias("words"))


def words(sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each word: id, sent_idx, word_idx, word, and a column for each annotation."""
    if "meta" not in sentences.columns:
        return sentences.select(id_col, "sent_idx", F.posexplode("words").alias("word_idx", "word"))
    both = sentences.select(id_col, "sent_idx", F.posexplode(F.arrays_zip("words", "meta")).alias("word_idx", "w"))
    return both.select(id_col, "sent_idx", "word_idx", F.col("w.words").alias("word"), "w.meta.*")


def call(f: Callable[..., Column], word: Column, meta: Column | None = None) -> Column:
    """``f`` of a word, or of the word and its annotations if it can take two positional arguments.

    ``f`` is anything that can be called: a function, a method, a partial, an object.
    """
    return f(word, meta) if meta is not None and _takes_two(f) else f(word)


def _takes_two(f: Callable) -> bool:
    try:
        parameters = inspect.signature(f).parameters.values()
    except (TypeError, ValueError):  # some callables of C have no signature
        return False
    needed = [p for p in parameters if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
    return len(needed) == 2 or len(needed) < 2 and any(p.kind == p.VAR_POSITIONAL for p in parameters)


def annotate(sentences: DataFrame, functions: dict[str, Callable[..., Column]]) -> DataFrame:
    """Sets the annotations of all words: name -> function of the word, or of the word and its
    annotations so far (if it takes two arguments). Earlier annotations are replaced."""
    if "meta" in sentences.columns:
        meta = F.transform(F.arrays_zip("words", "meta"), lambda p: F.struct(*[call(f, p["words"], p["meta"]).alias(k) for k, f in functions.items()]))
    else:
        meta = F.transform("words", lambda w: F.struct(*[call(f, w).alias(k) for k, f in functions.items()]))
    return sentences.select(*[c for c in sentences.columns if c != "meta"], meta.alias("meta"))


def map_words(sentences: DataFrame, name: str, distinct_column: Callable[[Column], Column], id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, word_idx, word, name): a costly Python function, run once for each distinct word.

    Words that are more than one in ``HEAVY`` of all, at most so many, are dealt over salts in proportion to their
    count, so none of them meets in one task.
    """
    rows = words(sentences, id_col)
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * HEAVY / counts.agg(F.sum("n")).scalar()
    heavy = F.broadcast(counts.where(share > 1).select("word", F.ceil(share).cast("int").alias("salts")))
    salted = rows.join(heavy, "word", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(id_col, "sent_idx", "word_idx"), "salts"), F.lit(0)).cast("int")).drop("salts")
    vocabulary = counts.join(heavy, "word", "left").select("word", "salts", distinct_column(F.col("word")).alias(name))
    vocabulary = vocabulary.select("word", name, F.explode_outer(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(vocabulary, ["word", "salt"]).select(id_col, "sent_idx", "word_idx", "word", name)


def map_words_by_sample(sentences: DataFrame, name: str, distinct_column: Callable[[Column], Column], sample: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``map_words`` in one pass over the words: the places of a word meet in a row, which the function sees, and part again.

    Words that are more than one in ``HEAVY`` of ``sample``, some of the sentences, are dealt over salts in proportion to their count,
    and the function is run once for each salt of them. The sample decides only how rows are dealt.
    """
    counts = words(sample, id_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(HEAVY).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    share = F.col("n") * HEAVY / F.col("all")
    heavy = F.broadcast(top.where(share > 1).select("word", F.ceil(share).cast("int").alias("salts")))
    rows = words(sentences, id_col).select(id_col, "sent_idx", "word_idx", "word")
    salted = rows.join(heavy, "word", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(id_col, "sent_idx", "word_idx"), "salts"), F.lit(0)).cast("int"))
    met = salted.groupBy("word", "salt").agg(F.collect_list(F.struct(id_col, "sent_idx", "word_idx")).alias("places"))
    made = met.select("word", "places", distinct_column(F.col("word")).alias(name)).select("word", name, F.explode_outer("places").alias("at"))
    return made.select(f"at.{id_col}", "at.sent_idx", "at.word_idx", "word", name)


def common_words(sample: DataFrame, functions: dict[str, Callable[[Column], Column]], limit: int = COMMON, id_col: str = "doc_id") -> DataFrame:
    """(word, a column for each function) of the most frequent words of some sentences.

    At most ``limit`` words of at most ``COMMON_LENGTH`` characters, so the table may be sent to all executors however
    large the sample is.
    """
    short = words(sample, id_col).where(F.length("word") <= COMMON_LENGTH)
    top = short.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return top.select("word", *[f(F.col("word")).alias(k) for k, f in functions.items()])


def words_by_vocabulary(sentences: DataFrame, functions: dict[str, Callable[[Column], Column]], known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, word_idx, word, a column for each function): values of words in ``known``, a table of
    ``common_words`` for the same functions, are looked up, those of others computed where they stand.

    Whatever words the table has, the result is the same; no word is shuffled.
    """
    held = F.broadcast(known.select(F.col("word").alias("known_"), *[F.col(k).alias(f"{k}_") for k in functions]))
    rows = words(sentences, id_col).join(held, F.col("word") == F.col("known_"), "left")
    return rows.select(id_col, "sent_idx", "word_idx", "word", *[F.when(F.col("known_").isNotNull(), F.col(f"{k}_")).otherwise(f(F.col("word"))).alias(k) for k, f in functions.items()])


def known_values(sample: DataFrame, f: Callable[[Column], Column], places: int = PLACES, id_col: str = "doc_id") -> Column:
    """Values of ``f`` for common words of some sentences, as one array of (word, base) that a word's hash points into.

    It is a scalar of bounded size (its bytes were not measured), computed once, for ``split_by_known``.
    """
    short = words(sample, id_col).where(F.length("word") <= COMMON_LENGTH)
    top = short.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(min(COMMON, places))
    kept = top.groupBy(_place(F.col("word"), places).alias("place")).agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    valued = kept.select("place", F.struct("word", f(F.col("word")).alias("base")).alias("known"))
    every = sample.sparkSession.range(places).select(F.col("id").cast("int").alias("place")).join(valued, "place", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "known"))), lambda x: x["known"])).scalar()


def _place(word: Column, places: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(places)).cast("int")


def split_by_known(df: DataFrame, f: Callable[[Column], Column], known: Column, places: int = PLACES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``split_sentences`` with ``f`` of each word in the word's place, read from ``known_values`` or, for words that are
    not there, computed. Whatever words the table has, the result is the same."""

    def based(ws: Column, table: Column) -> Column:
        found = F.transform(ws, lambda w: F.get(table, _place(w, places)))
        return F.zip_with(ws, found, lambda w, k: F.when(k["word"] == w, k["base"]).otherwise(f(w)))

    # nothing else stands between the two projections, so the optimizer makes them one and no row holds the table
    pieces = df.select(id_col, F.posexplode(sentence_pieces(F.col(text_col))).alias("sent_idx", "piece")).select(id_col, "sent_idx", "piece", known.alias("known_"))
    bound = F.transform(F.array("known_"), lambda table: F.transform(F.array(words_of(F.col("piece"))), lambda ws: based(ws, table))[0])[0]
    return pieces.select(id_col, "sent_idx", bound.alias("words"))


def sentence_text(words_col: Column) -> Column:
    return F.array_join(words_col, " ")


def document_texts(docs: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, n_sentences) of every document: sentences joined by a stop and a newline, and a last stop."""
    made = sentences.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sent_idx", sentence_text(F.col("words")).alias("s")))).alias("s"))
    all_ = docs.select(id_col).join(made, id_col, "left")
    text = F.concat(F.coalesce(F.array_join(F.transform("s", lambda x: x["s"]), ".\n"), F.lit("")), F.lit("."))
    return all_.select(id_col, text.alias("text"), F.coalesce(F.size("s"), F.lit(0)).cast("int").alias("n_sentences"))


def texts_in_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as ``document_texts`` from the texts themselves: nothing is exploded or shuffled."""
    return docs.select(id_col, document_text(F.col(text_col)).alias("text"), document_length(F.col(text_col)).alias("n_sentences"))


def parts_in_row(docs: DataFrame, parts: dict[str, tuple[int | None, int | None] | int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, sent_idx, words) of slices (start, stop) and items (index) of documents, in one pass and without a shuffle."""
    held = docs.select(id_col, F.transform(sentence_pieces(F.col(text_col)), lambda p, k: F.struct(k.alias("sent_idx"), p.alias("piece"))).alias("s"))
    n = F.size("s")

    def cut(part: tuple | int) -> Column:
        if isinstance(part, tuple):
            return py_slice(F.col("s"), *part)
        place = F.lit(part) if part >= 0 else n + part
        return F.when((place >= 0) & (place < n), F.slice("s", F.greatest(place, F.lit(0)) + 1, 1)).otherwise(F.slice("s", 1, 0))

    def tagged(name: str, part: tuple | int) -> Column:
        return F.transform(cut(part), lambda x: F.struct(F.lit(name).alias("part"), x["sent_idx"].alias("sent_idx"), x["piece"].alias("piece")))

    each = held.select(id_col, F.explode_outer(F.concat(*[tagged(*p) for p in parts.items()])).alias("x")).where("x IS NOT NULL")
    return each.select(id_col, "x.part", "x.sent_idx", words_of(F.col("x.piece")).alias("words"))


def sentence_slice(sentences: DataFrame, start: int | None, stop: int | None, id_col: str = "doc_id") -> DataFrame:
    return sentences.select(id_col, "sent_idx", sentence_text(py_slice(F.col("words"), start, stop)).alias("text"))


def document_slice(sentences: DataFrame, start: int | None = None, stop: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """``document[start:stop]``: those of each document's sentences, with the clamping of Python slices."""
    place = F.col("sent_idx")
    if (start or 0) >= 0 and (stop or 0) >= 0:
        return sentences.where((place >= (start or 0)) & (F.lit(True) if stop is None else place < stop))
    sizes = sentences.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_"))
    at = lambda x: F.lit(x) if x >= 0 else F.greatest(F.lit(0), F.col("n_") + x)
    test = (place >= at(start or 0)) & (F.lit(True) if stop is None else place < at(stop))
    return sentences.join(sizes, id_col).where(test).select(*sentences.columns)


def document_item(sentences: DataFrame, index: int, id_col: str = "doc_id") -> DataFrame:
    """``document[index]``: that sentence of each document; documents without it give none."""
    if index >= 0:
        return sentences.where(F.col("sent_idx") == index)
    sizes = sentences.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_"))
    return sentences.join(sizes, id_col).where(F.col("sent_idx") == F.col("n_") + index).select(*sentences.columns)
