import functools

import pytest
from pyspark.sql import functions as F

from lexispan.functions.stem import MODES, Columns, stem, steps
from lexispan.functions.text import py_slice, words_of
from lexispan.functions.words import dropping, is_alpha, not_among, word_type
from lexispan.operators.corpus import Corpus, annotate, common_words, document_item, document_slice, document_texts, known_values, map_words, map_words_by_sample, sentence_slice, sentence_text, split_by_known, split_sentences, words, words_by_vocabulary
from lexispan.operators.match import find_hits, find_span, fold_spans, is_empty, kb_from_callable, match, span_sizes, span_text, spans_of_candidates, windows
from lexispan.operators.resolve import longest, resolve, resolve_hits, resolve_in_python, shortest
from lexispan.plans.pipeline import Pipeline, load_texts, match_windows, process_spans, process_words
from lexispan.sources.knowledge import checked, from_dict
from lexispan.sources.texts import from_strings, from_words, read_texts

TEXT = "\tOak (Quercus), ash:birch;\nlarch! Do the gardeners' lists | plots of moss++ , and \u00a0 (((fern))) ?.. Was *that* all"
SENTENCE = "we planted one old oak tree beside the red brick wall of Kew".split(" ")
KB = {
    "oak": [{"concept_id": 10}], "old oak": [{"concept_id": 11}], "old oak tree": [{"concept_id": 12}, {"concept_id": 13}], "tree oak": [{"concept_id": 14}],
    "brick wall": [{"concept_id": 0}], "kew": [{"concept_id": 20}, None, {}, {"concept_id": 21}], "moss": [],
}


@pytest.fixture(scope="module")
def kb(spark):
    return from_dict(spark, KB, "struct<concept_id:int>")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def texts_of(spark, text):
    return [r[0] for r in split_sentences(from_strings(spark, text)).orderBy("sent_idx").select(F.array_join("words", " ")).collect()]


def test_sentences_and_words(spark):
    assert texts_of(spark, TEXT) == ["Oak Quercus ash birch larch", "Do the gardeners' lists", "plots of moss++ and fern", "Was *that* all"]
    raw = spark.createDataFrame([(":fern;, ((moss)|ash ,,",)], "s string")
    assert raw.select(words_of(F.col("s"))).first()[0] == ["fern", "moss", "ash"]


@pytest.mark.parametrize(("text", "want"), [("", []), ("   ", []), ("a. ! b", ["a", "", "b"]), ("a|b", ["a", "b"]), ("x y\x1cz\x0bw", ["x y z w"]), ("3.5", ["3", "5"])])
def test_sentence_edges(spark, text, want):
    assert texts_of(spark, text) == want


def test_null_text_and_document_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b. ! c?")], "doc_id long, text string")
    assert rows(document_texts(docs, split_sentences(docs)), "doc_id") == [(1, ".", 0), (2, ".", 0), (3, "a b.\n.\nc.", 3)]


def test_to_string_and_slices(spark):
    first, second = "two boats left the harbour".split(), "nobody saw them again".split()
    s = from_words(spark, first, second)
    assert rows(s.select("sent_idx", sentence_text(F.col("words")), F.size("words")), "sent_idx")[1] == (1, "nobody saw them again", 4)
    for a, z in ((None, None), (1, -1), (-2, None), (-9, 9), (3, 1), (9, None)):
        assert rows(s.select("sent_idx", py_slice(F.col("words"), a, z)), "sent_idx")[0][1] == first[a:z]
    assert rows(sentence_slice(s, 0, 2), "sent_idx")[0][2] == "two boats"


@pytest.mark.parametrize(("start", "stop"), [(None, None), (1, None), (0, 2), (1, -1), (-2, None), (-9, 9), (3, 1), (9, None), (None, -1)])
def test_document_slices(spark, start, stop):
    s = from_words(spark, ["a"], ["b"], [], ["d"]).unionByName(from_words(spark, ["e"], doc_id=1))
    got = document_slice(s, start, stop).orderBy("doc_id", "sent_idx").collect()
    for doc, idx in ((0, [0, 1, 2, 3]), (1, [0])):
        assert [r["sent_idx"] for r in got if r["doc_id"] == doc] == idx[start:stop]
    assert document_slice(s, start, stop).columns == s.columns


def test_document_items(spark):
    s = from_words(spark, ["a"], ["b"], ["c"]).unionByName(from_words(spark, ["e"], doc_id=1))
    got = {k: [(r["doc_id"], r["words"][0]) for r in document_item(s, k).orderBy("doc_id").collect()] for k in (0, 2, -1, -3, 5, -5)}
    assert got == {0: [(0, "a"), (1, "e")], 2: [(0, "c")], -1: [(0, "c"), (1, "e")], -3: [(0, "a")], 5: [], -5: []}


def test_word_types(spark):
    df = spark.createDataFrame([("those",), ("THOSE",), ("isn't",), ("harbour",)], "w string")
    assert [tuple(r) for r in df.select(word_type(F.col("w")), word_type(F.col("w"), to_lowercase=False)).collect()] == [("STOP_WORD", "STOP_WORD"), ("STOP_WORD", "STANDARD"), ("STOP_WORD", "STOP_WORD"), ("STANDARD", "STANDARD")]


@pytest.mark.parametrize(
    ("mode", "pairs"),
    [
        (MODES[0], {"adjustment": "adjust", "national": "nation", "adoption": "adopt", "harbours": "harbour", "dying": "die", "Dying": "dy", "skies": "sky", "a*ded": "ad", "dies": "die", "ies": "i", "as": "as", "agreed": "agre", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "enjoy": "enjoy", "rationally": "ration", "geologi": "geolog", "yyy": "yyy"}),
        (MODES[1], {"dying": "dy", "ies": "i", "as": "as", "geologi": "geologi", "archaeologi": "archaeolog", "conformably": "conform"}),
        (MODES[2], {"s": "", "as": "a", "ies": "i", "conformabli": "conform", "relational": "relat", "sky": "sky"}),
    ],
)
def test_stems(spark, mode, pairs):
    df = spark.createDataFrame([(w,) for w in pairs], "w string")
    assert {r[0]: r[1] for r in df.select("w", stem(F.col("w"), mode)).collect()} == pairs


def test_stem_mode_and_case(spark):
    with pytest.raises(ValueError):
        stem(F.col("w"), "OTHER")
    df = spark.createDataFrame([("RUNNING",), ("Running",)], "w string")
    assert [r[0] for r in df.select(stem(F.col("w"), to_lowercase=False)).collect()] == ["RUNNING", "Run"]


def test_stem_of_words_with_line_ends(spark):
    df = spark.createDataFrame([("\nplanted",), ("plant\n",), ("\n",)], "w string")
    assert [r[0] for r in df.select(stem(F.col("w"))).collect()] == ["\nplant", "plant\n", "\n"]


def test_word_filters(spark):
    s = from_words(spark, "Planted near 1904 by OakLovers at an old 3rd Wall by the sea".split())
    kept = dropping(is_alpha, not_among("by", "at", "an"))
    got = s.select(F.array_join(F.transform("words", kept), " ")).first()[0]
    assert got == "planted near oaklovers old wall the sea"
    assert not spark.createDataFrame([("ash\n",)], "w string").select(is_alpha(F.col("w"))).first()[0]


def spans(df):
    return [(r["sent_idx"], r["start"], r["stop"], [(c["start"], c["stop"], c["concept_id"]) for c in r["candidates"]]) for r in df.orderBy("doc_id", "sent_idx", "matcher_idx", "start").collect()]


def test_matcher(spark, kb):
    s = from_words(spark, SENTENCE)
    found = match(s, kb, 4, F.lower)
    assert spans(found) == [(0, 3, 6, [(3, 6, 12), (3, 6, 13), (3, 5, 11)]), (0, 4, 5, [(4, 5, 10)]), (0, 9, 11, [(9, 11, 0)]), (0, 12, 13, [(12, 13, 20), (12, 13, 21)])]
    assert [r["span_text"] for r in span_text(found, s).orderBy("start").collect()] == ["old oak tree", "oak", "brick wall", "Kew"]
    assert spans(match(s, kb, 4))[-1][1] == 9  # by default case counts
    assert spans(match(s, kb, 0, F.lower)) == []
    for size in (2, 3, 17, 40):  # written out, and by lambdas
        assert spans(match(s, kb, size, F.lower))[0] == (0, 3, min(3 + size, 6), [(3, 6, 12), (3, 6, 13), (3, 5, 11)][(size < 3) * 2 :])
    assert rows(span_sizes(find_hits(s, kb, 4, F.lower)), "start") == [(0, 0, 3, 6, 3), (0, 0, 4, 5, 1), (0, 0, 9, 11, 1), (0, 0, 12, 13, 2)]


@pytest.mark.parametrize(("start", "want"), [(3, (3, 6, 3)), (4, (4, 5, 1)), (5, (5, 5, 0)), (12, (12, 13, 2)), (13, (13, 13, 0)), (99, (99, 99, 0)), (-1, (-1, -1, 0))])
def test_span_at_one_start(spark, kb, start, want):
    got = find_span(from_words(spark, SENTENCE), kb, start, 4, F.lower).first()
    assert (got["start"], got["stop"], len(got["candidates"])) == want
    assert [c["start"] for c in got["candidates"]] == [start] * want[2]


def test_dropped_words(spark, kb):
    drop = dropping(not_among("the"))
    assert spans(match(from_words(spark, ["oak", "the"]), kb, 4, drop)) == [(0, 0, 2, [(0, 2, 10), (0, 1, 10)])]
    assert [x[1:3] for x in spans(match(from_words(spark, ["the", "oak"]), kb, 4, drop))] == [(0, 2), (1, 2)]


class Lower:
    def __call__(self, word):
        return F.lower(word)

    def of(self, word):
        return F.lower(word)

    def marked(self, word, meta):
        return meta["low"]


def either(word, meta=None, default="x"):
    return F.lower(word)


@pytest.mark.parametrize("hook", [Lower(), Lower().of, Lower().marked, functools.partial(lambda f, w: f(w), F.lower), functools.partial(lambda f, w, meta: meta["low"], None), either, F.lower, lambda *x: x[1]["low"]])
def test_hooks_are_any_callable(spark, kb, hook):
    s = annotate(from_words(spark, SENTENCE), {"low": Lower()})
    assert len(spans(match(s, kb, 4, hook))) == 4
    assert words(annotate(s, {"again": hook})).where("word = 'Kew'").first()["again"] == "kew"


def test_windows_stay_in_sentences(spark):
    got = windows(from_words(spark, ["a", "b"], [], ["c"]), 3)
    assert rows(got, "sent_idx", "start", "stop") == [(0, 0, 0, 1, "a"), (0, 0, 0, 2, "a b"), (0, 0, 1, 2, "b"), (0, 2, 0, 1, "c")]


def test_windows_are_computed_once(spark):
    plan = windows(split_sentences(from_strings(spark, "a b c")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "size(flatten" not in plan


def test_small_kb_is_broadcast(spark, kb):
    assert "BroadcastHashJoin" in match(from_words(spark, SENTENCE), kb, 4, F.lower)._jdf.queryExecution().executedPlan().toString()


def test_resolver_takes_first_of_longest(spark):
    df = spark.createDataFrame([(0, [(2, 3, 5)]), (1, [(6, 7, 1), (6, 9, 2), (5, 8, 3)])], "k int, candidates array<struct<start:int,stop:int,concept_id:int>>")
    assert rows(resolve(df, {"best": longest}).select("k", "best.concept_id"), "k") == [(0, 5), (1, 2)]
    assert rows(df.select("k", is_empty(F.col("candidates"), F.lit(1), F.lit(1))), "k") == [(0, True), (1, True)]
    assert rows(df.select("k", is_empty(F.col("candidates"), F.lit(1), F.lit(2))), "k") == [(0, False), (1, False)]


def test_resolvers_straight_from_hits(spark, kb):
    hits = find_hits(from_words(spark, SENTENCE), kb, 4, F.lower)
    for pick, by_longest in ((longest, True), (shortest, False)):
        want = resolve(fold_spans(hits), {"best": pick}).select("doc_id", "sent_idx", "start", "stop", "best")
        assert rows(resolve_hits(hits, "best", by_longest), "start") == rows(want, "start")


def test_resolvers_see_the_span(spark, kb):
    found = match(from_words(spark, SENTENCE), kb, 4, F.lower)
    first = resolve(found, {"width": lambda cs, span: span["stop"] - span["start"]})
    again = resolve(first, {"both": lambda cs, span: span["width"] * 10 + F.size(cs)})
    assert again.columns == [*found.columns, "both"] and [r["both"] for r in again.orderBy("start").collect()] == [33, 11, 21, 12]
    python = resolve_in_python(first, {"last": lambda span: span["candidates"][-1]["concept_id"] + span["width"] + span["start"], "none": lambda span: None}, {"last": "long", "none": "string"})
    assert [(r["last"], r["none"]) for r in python.orderBy("start").collect()] == [(17, None), (15, None), (11, None), (34, None)]


def test_candidates_are_added_one_by_one(spark):
    """A span without width is set anew by the next candidate; others are widened."""
    df = spark.createDataFrame([(0, 0, 4, 6), (0, 1, 5, 9), (0, 2, 1, 2), (1, 0, 3, 3), (1, 1, 7, 8), (1, 2, 5, 6)], "k int, nth int, start int, stop int")
    assert [(r["k"], r["start"], r["stop"], len(r["candidates"])) for r in spans_of_candidates(df, "k").orderBy("k").collect()] == [(0, 1, 9, 3), (1, 5, 8, 3)]


def test_map_words(spark):
    s = from_words(spark, ["Ash", "oak", "Ash"], ["oak"])
    assert rows(map_words(s, "low", F.lower).select("sent_idx", "word_idx", "low"), "sent_idx", "word_idx") == [(0, 0, "ash"), (0, 1, "oak"), (0, 2, "ash"), (1, 0, "oak")]


def test_heavy_words_are_salted(spark):
    s = from_words(spark, *[["the"] * 50 + [f"w{k}"] for k in range(40)])
    got = map_words(s, "low", F.upper)
    assert got.count() == 2040 and got.where("low <> upper(word)").count() == 0
    heavy = [r for r in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "salts" in r]
    assert heavy


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_common_words_are_looked_up(spark, limit):
    s = from_words(spark, ["running", "the", "running", "x" * 60], ["dying", "the", "the"], [])
    functions = {"stem": stem, "low": F.lower}
    known = common_words(s.where("sent_idx <> 1"), functions, limit)
    assert known.count() == min(limit, 2)  # words that are too long are not among them
    got = words_by_vocabulary(s, functions, known)
    want = words(s).select("*", stem(F.col("word")).alias("stem"), F.lower("word").alias("low"))
    assert rows(got, "sent_idx", "word_idx") == rows(want, "sent_idx", "word_idx")
    assert "Exchange hash" not in words_by_vocabulary(s, functions, spark.createDataFrame([("a", "a", "a")], "word string, stem string, low string"))._jdf.queryExecution().executedPlan().toString()


def test_annotations_are_replaced_but_seen(spark):
    s = annotate(from_words(spark, ["Ash", "or"]), {"low": lambda w: F.lower(w)})
    again = annotate(s, {"twice": lambda w, meta: F.concat(meta["low"], w)})
    assert words(again).columns == ["doc_id", "sent_idx", "word_idx", "word", "twice"]
    assert [r["twice"] for r in words(again).orderBy("word_idx").collect()] == ["ashAsh", "oror"]


def test_pipeline(spark, kb):
    docs = from_strings(spark, "Look at KEW. An Old oak!")
    line = Pipeline().add(load_texts(docs), "t").add(process_words({"low": lambda w: F.lower(w)}), "w")
    line.add(match_windows(kb, 4, lambda w, meta: meta["low"]), "m").add(process_spans({"best": longest}), "r")
    assert [r["best"]["concept_id"] for r in line.run().spans.orderBy("sent_idx", "start").collect()] == [20, 11, 10]
    line.add(match_windows(kb, 1, lambda w, meta: meta["low"]), "m")
    assert list(line.stages) == ["t", "w", "m", "r"]
    assert [r["best"]["concept_id"] for r in line.run().spans.orderBy("sent_idx", "start").collect()] == [20, 10]
    line.add(match_windows(kb, 4, F.lower), "m2")
    assert [r["matcher_idx"] for r in line.run().spans.orderBy("sent_idx", "matcher_idx").collect()] == [0, 1, 0, 1, 1]
    assert Pipeline().run(Corpus()).sentences is None
    assert load_texts(docs)(line.run()).spans is None


def test_callable_knowledge_base(spark, tmp_path):
    s = from_words(spark, ["Alder", "fir"], ["fir", "fir"])

    def ask(query):
        with open(tmp_path / "asked", "a") as f:
            f.write(query + "\n")
        return [{"concept_id": query[0]}, {}] if query == "fir" else None

    kb = kb_from_callable(windows(s, 1, F.lower), ask)
    assert spans(match(s, kb, 1, F.lower)) == [(0, 1, 2, [(1, 2, "f")]), (1, 0, 1, [(0, 1, "f")]), (1, 1, 2, [(1, 2, "f")])]
    assert sorted((tmp_path / "asked").read_text().split()) == ["alder", "fir"]  # once for each distinct query


def test_responses_are_kept_whole(spark):
    kb = from_dict(spark, {"ash": [{"concept_id": 1, "kind": "tree", "height": 20}, {"concept_id": 2, "kind": "fire", "height": 0.5}], "oak": [{"concept_id": 3, "native": True}], "fir": None})
    assert dict(kb.dtypes)["responses"] == "array<struct<concept_id:bigint,kind:string,height:double,native:boolean>>"
    got = match(from_words(spark, ["ash", "oak"]), kb, 1).orderBy("start").collect()
    assert [[c["response"].asDict() for c in r["candidates"]] for r in got] == [[{"concept_id": 1, "kind": "tree", "height": 20.0, "native": None}, {"concept_id": 2, "kind": "fire", "height": 0.5, "native": None}], [{"concept_id": 3, "kind": None, "height": None, "native": True}]]
    mixed = from_dict(spark, {"a": [{"concept_id": 1}, {"concept_id": "x"}]})
    assert [c["concept_id"] for c in mixed.first()["responses"]] == ["1", "x"]


def test_faulty_knowledge_bases(spark):
    kind = "query string, responses array<struct<concept_id:string>>"
    with pytest.raises(ValueError):
        from_dict(spark, {"a": [{"concept_id": None, "kind": "x"}]})
    for rows_, text in (([("red", [("2",)]), ("red", [("1",)])], "two rows of red"), ([("red", [("2",), (None,)])], "no concept_id in a response to red")):
        with pytest.raises(Exception, match=text):
            checked(spark.createDataFrame(rows_, kind)).collect()
    good = spark.createDataFrame([("red", [("2",), None, ("1",)]), (None, [("3",)]), ("no", []), ("none", None)], kind)
    assert [(r["query"], [c["concept_id"] for c in r["responses"]]) for r in checked(good).collect()] == [("red", ["2", "1"])]


def test_knowledge_sources(spark, kb, tmp_path):
    with pytest.raises(ValueError):
        from_dict(spark, {"a": [{"id": 1}]})
    with pytest.raises(ValueError):
        checked(spark.createDataFrame([("a", 1)], "query string, responses int"))
    from_strings(spark, "a", "b").write.json(str(tmp_path / "j"))
    assert read_texts(spark, str(tmp_path / "j"), "json").count() == 2


def test_stream(spark, kb, tmp_path):
    from lexispan.streaming.spans import stream_spans

    from_strings(spark, "the oak.", "no one").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    out = []
    q = stream_spans(stream, {"m": match_windows(kb, 4, F.lower)}, lambda df, k: out.extend(spans(df)), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert out == [(0, 1, 2, [(1, 2, 10)])]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_map_words_by_sample_passes_once(spark):
    """No word is joined to a table of all words, and the sample changes no result."""
    s = from_words(spark, *[["the"] * 50 + [f"w{k}"] for k in range(40)])
    for sample in (s, s.where("sent_idx < 3"), s.where("sent_idx < 0")):
        got = map_words_by_sample(s, "up", F.upper, sample)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, map_words(s, "up", F.upper).collect()))
    plan = map_words_by_sample(s, "up", F.upper, s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "salts" in plan


def test_known_values_are_read_where_sentences_are_split(spark):
    """The same stems as where they are computed, whatever words the table has; no row holds the table."""
    docs = from_strings(spark, "Running dogs, skies. The news || flying Flying ponies", None, "", "relational (ties) zzz9 running")
    want = rows(split_sentences(docs).select("doc_id", "sent_idx", F.transform("words", lambda w: stem(w)).alias("words")), "doc_id", "sent_idx")
    for sample, places in ((docs, 1 << 10), (docs, 2), (docs.limit(0), 16)):
        found = split_by_known(docs, stem, known_values(split_sentences(sample), stem, places), places)
        assert rows(found, "doc_id", "sent_idx") == want
        assert "AS known_#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_last_letters_that_no_step_changes(spark):
    """The shortcut of the stemmer: words of every last letter are as their steps make them."""
    words = [w + c for w in ("Abiliti", "relation", "hopp", "rat", "", "b") for c in "abcdefghijklmnopqrstuvwxyz9\u00e9S"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for mode in MODES:
        for low in (True, False):
            out = F.lower("word") if low else F.col("word")
            for step in steps(Columns(), mode):
                out = F.transform(F.array(out), step)[0]
            wrong = frame.where(F.length("word") > 2).where(~out.eqNullSafe(stem(F.col("word"), mode, low)))
            assert wrong.collect() == []
