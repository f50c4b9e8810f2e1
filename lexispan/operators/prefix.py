"""Matching that grows windows only while the knowledge base goes on, for registered knowledge bases.

From each start the window grows by a word as long as its query is the beginning of a longer one in the knowledge base. Levels are
left joins with the same table, one behind the other in one stage; a start that has ended meets none of the
later ones.

``spans_in_row``: for knowledge bases that may be broadcast. The hits of a start stay in its row, so spans need
no shuffle and no state, also in a stream; several matchers share the pass.
``grown_windows``: for larger ones. Levels ask a Bloom filter of prefixes, of bounded size, and only windows that
the filter of queries lets through are left to be joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.operators.match import LEVELS, candidates_of, kept_words
from lexispan.sources.registry import KnowledgeBase, bits_hash, block_of, in_filter


@dataclass(frozen=True)
class Matcher:
    kb: KnowledgeBase
    size: int = 4
    pre_filter: Callable[..., Column] | None = None


def _starts(sentences: DataFrame, filters: list[Callable | None], id_col: str, first_only: bool = False) -> DataFrame:
    """(id, sent_idx, n, kept0, kept1, ..., start): a row for each word, or one for the first of each sentence."""
    kept = lambda f: kept_words(sentences, f) if f else F.transform("words", lambda w: F.nullif(w, F.lit("")))  # noqa: E731  words that are left out are null
    rows = sentences.select(id_col, "sent_idx", F.size("words").alias("n"), *[kept(f).alias(f"kept{g}") for g, f in enumerate(filters)])
    if first_only:
        return rows.withColumn("start", F.lit(0))
    return rows.select(*rows.columns, F.posexplode_outer("kept0").alias("start", "_")).where("start IS NOT NULL").drop("_")


def _word(group: int, level: int) -> Column:
    return F.get(f"kept{group}", F.col("start") + (level - 1))


def _query(word: Column, level: int, before: str | None = None, known: Column | None = None, more: Column | None = None) -> Column:
    """The query of the window of ``level`` words, null where the window has ended.

    It goes on behind a beginning of a longer query; behind a query that no longer one follows, only by words that
    are left out of it.
    """
    if level == 1:  # a sentence may have no first word
        return F.when(F.col("start") < F.col("n"), F.coalesce(word, F.lit("")))
    goes_on = (F.col("start") + level <= F.col("n")) & (more | (known & word.isNull()))
    return F.when(goes_on, F.concat_ws(" ", F.nullif(F.col(before), F.lit("")), word))


def _joint(matchers: list[Matcher]) -> list[tuple[list[int], DataFrame, int, Callable | None]]:
    """Matchers by their word filter: which they are, the prefix table of all, the largest size, the filter."""
    out = []
    for f in dict.fromkeys(id(m.pre_filter) for m in matchers):
        own = [k for k, m in enumerate(matchers) if id(m.pre_filter) == f]
        tables = {id(matchers[k].kb): matchers[k].kb for k in own}
        if len(tables) == 1:
            kb = matchers[own[0]].kb
            table = kb.prefixes.select("prefix", "more", *[F.col("responses").alias(f"r{k}") for k in own])
        else:  # a tagged union of their tables
            tagged = None
            for kb in tables.values():
                its = [k for k in own if matchers[k].kb is kb]
                part = kb.prefixes.select("prefix", "more", *[F.col("responses").alias(f"r{k}") for k in its])
                tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
            table = tagged.groupBy("prefix").agg(F.bool_or("more").alias("more"), *[F.first(f"r{k}", ignorenulls=True).alias(f"r{k}") for k in own])
        out.append((own, table, max(matchers[k].size for k in own), matchers[own[0]].pre_filter))
    return out


def _grow(sentences: DataFrame, matchers: list[Matcher], id_col: str, first_only: bool = False) -> tuple[DataFrame, list[list[tuple[int, str]]], list[str]]:
    """Starts with the answers of each level, the columns of answers of each matcher, and the columns of queries."""
    if any(m.size > LEVELS for m in matchers):
        raise ValueError(f"windows of more than {LEVELS} words do not grow level by level")
    groups = _joint(matchers)
    frame = _starts(sentences, [f for *_, f in groups], id_col, first_only)
    answers: list[list[tuple[int, str]]] = [[] for _ in matchers]
    queries = []
    for g, (own, table, size, _) in enumerate(groups):
        before: tuple = ()
        for level in range(1, size + 1):
            q, known = f"q{g}_{level}", f"p{g}_{level}"
            frame = frame.withColumn(q, _query(_word(g, level), level, *before))
            here = table.select(F.col("prefix").alias(known), F.col("more").alias(f"m{g}_{level}"), *[F.col(f"r{k}").alias(f"r{k}_{level}") for k in own])
            frame = frame.join(F.broadcast(here), F.col(q) == F.col(known), "left")
            before = (q, F.col(known).isNotNull(), F.col(f"m{g}_{level}"))
            queries.append(q)
            for k in own:
                if level <= matchers[k].size:
                    answers[k].append((level, f"r{k}_{level}"))
    return frame, answers, queries


def windows_made(sentences: DataFrame, matcher: Matcher, id_col: str = "doc_id") -> DataFrame:
    """(n_words, n_windows): how many windows of each size are made and looked up."""
    frame, _, queries = _grow(sentences, [matcher], id_col)
    counts = frame.agg(*[F.count(q).alias(q) for q in queries])
    return counts.select(F.posexplode(F.array(*queries)).alias("k", "n_windows")).select((F.col("k") + 1).alias("n_words"), "n_windows")


def _hit(answers: list[tuple[int, str]]) -> Column:
    """Whether a start has an answer at one of the levels."""
    return F.coalesce(*[F.col(r) for _, r in answers]).isNotNull() if answers else F.lit(False)


def _stop(level: int) -> Column:
    return (F.col("start") + level).cast("int")


def _apart(column: Column) -> Column:
    """The column itself. A lambda keeps its projection out of the joins' compiled stage: together they would make a method of
    more than the 8,000 bytes that the JVM compiles, while outside each expression is a method of its own."""
    return F.get(F.transform(F.array(column), lambda x: x), 0)


def _grown_hits(sentences: DataFrame, matchers: list[Matcher], id_col: str) -> tuple[DataFrame, list[list[tuple[int, str]]]]:
    """Starts with a hit of any matcher, and the columns of answers of each matcher, longest first."""
    if not all(m.kb.small for m in matchers):
        raise ValueError("only small knowledge bases are broadcast")
    frame, answers, _ = _grow(sentences, matchers, id_col)
    return frame.where(_hit([x for a in answers for x in a])), [a[::-1] for a in answers]


def hits_in_row(sentences: DataFrame, matchers: list[Matcher], id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, hits0, hits1, ...): the hits of each matcher (stop, responses), longest first; only
    starts with a hit."""
    frame, answers = _grown_hits(sentences, matchers, id_col)
    kind = lambda m: f"array<struct<stop:int,responses:{m.kb.about['schema']}>>"
    made = [F.filter(F.array(*[F.struct(_stop(level).alias("stop"), F.col(r).alias("responses")) for level, r in a]), lambda h: h["responses"].isNotNull()) if a else F.array().cast(kind(m)) for m, a in zip(matchers, answers)]
    return frame.select(id_col, "sent_idx", "start", *[h.alias(f"hits{k}") for k, h in enumerate(made)])


def hit_rows(sentences: DataFrame, matcher: Matcher, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, responses): a row for each hit. Nothing is done by a lambda for each response."""
    frame, (levels,) = _grown_hits(sentences, [matcher], id_col)
    if not levels:
        return frame.select(id_col, "sent_idx", "start", F.col("start").alias("stop"), F.lit(None).cast(matcher.kb.about["schema"]).alias("responses"))
    each = F.array(*[F.when(F.col(r).isNotNull(), F.struct(_stop(level).alias("stop"), F.col(r).alias("responses"))) for level, r in levels])
    made = frame.select(id_col, "sent_idx", _apart(F.col("start")).alias("start"), each.alias("each"))
    return made.select(id_col, "sent_idx", "start", F.explode_outer("each").alias("h")).where("h IS NOT NULL").select(id_col, "sent_idx", "start", "h.stop", "h.responses")


def _level_candidates(level: int, responses: Column) -> Column:
    """The candidates of a start's answers at one level, as ``candidates_of`` makes them. Zipped arrays are compiled, where
    a lambda would be interpreted for each response."""
    n = F.size(responses)
    columns = {"start": F.array_repeat(F.col("start"), n), "stop": F.array_repeat(_stop(level), n), "resp_idx": F.sequence(F.lit(0), n - 1), "concept_id": responses["concept_id"], "response": responses}
    return F.arrays_zip(*[c.alias(name) for name, c in columns.items()])


def candidates_in_row(answers: list[tuple[int, str]], schema: str) -> Column:
    """The candidates of a start, from the columns of its answers, longest first."""
    none = F.array().cast(f"array<struct<start:int,stop:int,resp_idx:int,concept_id:{_concept(schema)},response:{_element(schema)}>>")
    each = [F.when(F.col(r).isNotNull(), _level_candidates(level, F.col(r))).otherwise(none) for level, r in answers]
    return F.concat(*each) if each else none


def _element(schema: str) -> str:
    return T._parse_datatype_string(schema).elementType.simpleString()


def _concept(schema: str) -> str:
    return T._parse_datatype_string(schema).elementType["concept_id"].dataType.simpleString()


def _first_stop(answers: list[tuple[int, str]]) -> Column:
    return F.coalesce(*[F.when(F.col(r).isNotNull(), _stop(level)) for level, r in answers], F.lit(None).cast("int"))


def _answered(sentences: DataFrame, matcher: Matcher, id_col: str) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Starts with a hit, and (stop, responses or null) of each level, longest first."""
    if not matcher.kb.small:
        raise ValueError("only small knowledge bases are broadcast")
    frame, (levels,), _ = _grow(sentences, [matcher], id_col)
    if not levels:
        levels, frame = [(1, "r0_1")], frame.withColumn("r0_1", F.lit(None).cast(matcher.kb.about["schema"]))
    return frame.where(F.coalesce(*[F.col(r) for _, r in levels]).isNotNull()), [((F.col("start") + k).cast("int"), F.col(r)) for k, r in reversed(levels)]


def sizes_in_row(sentences: DataFrame, matcher: Matcher, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, n_candidates) of each span."""
    frame, levels = _answered(sentences, matcher, id_col)
    n = sum((F.when(r.isNotNull(), F.size(r)).otherwise(0) for _, r in levels), F.lit(0))
    return frame.select(id_col, "sent_idx", "start", F.coalesce(*[F.when(r.isNotNull(), stop) for stop, r in levels]).alias("stop"), n.alias("n_candidates"))


def best_in_row(sentences: DataFrame, matcher: Matcher, name: str, longest_window: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, name): the first candidate of the longest, or of the shortest, window of each span."""
    frame, levels = _answered(sentences, matcher, id_col)
    hit = F.coalesce(*[F.when(r.isNotNull(), F.struct("start", stop.alias("stop"), F.slice(r, 1, 1).alias("responses"))) for stop, r in (levels if longest_window else levels[::-1])])
    held = frame.select(id_col, "sent_idx", "start", F.coalesce(*[F.when(r.isNotNull(), stop) for stop, r in levels]).alias("stop"), hit.alias("hit"))
    return held.select(id_col, "sent_idx", "start", "stop", F.get(candidates_of(F.col("hit")), 0).alias(name))


def spans_in_row(sentences: DataFrame, matchers: list[Matcher], first_idx: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, matcher_idx, start, stop, candidates) of all matchers, numbered from ``first_idx`` on."""
    if len({m.kb.about["schema"] for m in matchers}) > 1:
        raise ValueError("matchers that share a pass have responses of one type")
    frame, answers = _grown_hits(sentences, matchers, id_col)
    span = lambda m, a: (_first_stop(a).alias("stop"), candidates_in_row(a, m.kb.about["schema"]).alias("candidates"))
    if len(matchers) == 1:
        return frame.select(id_col, "sent_idx", F.lit(first_idx).alias("matcher_idx"), _apart(F.col("start")).alias("start"), *span(matchers[0], answers[0]))
    tagged = F.array(*[F.when(_hit(a), F.struct(F.lit(first_idx + k).alias("matcher_idx"), *span(m, a))) for k, (m, a) in enumerate(zip(matchers, answers))])
    made = frame.select(id_col, "sent_idx", _apart(F.col("start")).alias("start"), tagged.alias("tagged"))
    each = made.select(id_col, "sent_idx", "start", F.explode_outer("tagged").alias("m")).where("m IS NOT NULL")
    return each.select(id_col, "sent_idx", "m.matcher_idx", "start", "m.stop", "m.candidates")


def span_at(sentences: DataFrame, matcher: Matcher, start: int, id_col: str = "doc_id") -> DataFrame:
    """The span at one start of each sentence, in the sentence's row; ``sentences`` begin at that start already."""
    if not matcher.kb.small:
        raise ValueError("only small knowledge bases are broadcast")
    frame, (levels,), _ = _grow(sentences, [matcher], id_col, first_only=True)
    frame, levels = frame.withColumn("start", F.lit(start)), levels[::-1]
    stop = F.coalesce(_first_stop(levels), F.lit(start))
    return frame.select(id_col, _apart(F.col("sent_idx")).alias("sent_idx"), F.lit(0).alias("matcher_idx"), "start", stop.alias("stop"), candidates_in_row(levels, matcher.kb.about["schema"]).alias("candidates"))


def grown_windows(sentences: DataFrame, kb: KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, query) of the windows that may be queries of a knowledge base with filters."""
    if kb.filter is None:
        raise ValueError(f"{kb.name} was registered without filters")
    if size <= 0:
        sentences, size = sentences.where(F.lit(False)), 1
    if size > LEVELS:
        raise ValueError(f"windows of more than {LEVELS} words do not grow level by level")
    # rows carry the words of their windows: a plan of this length is not compiled as a whole, and would copy the sentence for each word
    frame, before, found = _starts(sentences, [pre_filter], id_col).select(id_col, "sent_idx", "n", "start", *[_word(0, k).alias(f"w{k}") for k in range(1, size + 1)]), (), []
    for level in range(1, size + 1):
        q, known, asked = f"q{level}", f"p{level}_", f"a{level}_"
        frame = frame.withColumn(q, _query(F.col(f"w{level}"), level, *before)).withColumns({"at_": block_of(F.col(q), kb.about["blocks"]), "h_": bits_hash(F.col(q))})
        here = kb.filter.select(*[F.col(c).alias(f"{c}_{level}") for c in kb.filter.columns])
        frame = frame.join(F.broadcast(here), F.when(F.col(q).isNotNull(), F.col("at_")) == F.col(f"block_{level}"), "left")
        word = lambda c, level=level: F.col(f"{c}_{level}")
        test = lambda kind, word=word: F.coalesce(in_filter(F.col("h_"), kind, word), F.lit(False))
        frame = frame.withColumns({known: test("p"), asked: test("q")}).drop(*here.columns, "at_", "h_")
        before = (q, F.col(asked), F.col(known))
        found.append(F.when(F.col(asked) & F.col(q).isNotNull(), F.struct(_stop(level).alias("stop"), F.col(q).alias("query"))))
    some = F.col("a1_")
    for level in range(2, size + 1):
        some = some | F.col(f"a{level}_")
    # windows that are not asked for leave behind the explode: a lambda that filters them would be interpreted for each start
    asked = frame.where(some).select(id_col, "sent_idx", "start", F.explode_outer(F.array(*found)).alias("w")).where("w IS NOT NULL")
    return asked.select(id_col, "sent_idx", "start", "w.stop", "w.query")
