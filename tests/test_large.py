"""Registered knowledge bases, windows that grow, large lookups, streams, table functions and overlaps."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispan.functions.words import dropping, not_among
from lexispan.operators.ask import asked_hits
from lexispan.operators.corpus import document_item, document_slice, document_texts, parts_in_row, split_sentences, texts_in_row
from lexispan.operators.lookup import bucketed_hits, hot_queries, large_hits
from lexispan.operators.match import candidates_by_window, find_hits, find_span, fold_spans, match, match_all, span_sizes, span_sizes_of, window_counts, windows
from lexispan.operators.overlap import without_overlaps
from lexispan.operators.prefix import Matcher, best_in_row, grown_windows, hits_in_row, spans_in_row, windows_made
from lexispan.operators.resolve import longest, resolve, shortest
from lexispan.plans.pipeline import Pipeline, load_texts, match_windows, process_words
from lexispan.sources.knowledge import from_dict
from lexispan.sources.registry import Registry, fingerprint
from lexispan.sources.shared import shared_dir
from lexispan.sources.texts import from_strings, stream_texts
from lexispan.streaming.spans import append_to, span_stream

KIND = "query string, responses array<struct<concept_id:int,kind:string>>"
WORDS = ["red", "oak", "tree", "old", "the", "of", "Kew"]
no_the = dropping(not_among("the"))


def sentences(spark, n=120, seed=2):
    r = random.Random(seed)
    rows = [(k // 3, k % 3, [r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 5, 9]))]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, sent_idx int, words array<string>").repartition(3)


def entries(seed=3, empty=True):
    r = random.Random(seed)
    queries = {" ".join(r.choice(WORDS).lower() for _ in range(r.randint(1, 5))) for _ in range(60)} | ({""} if empty else set())
    return [(q, [(r.randint(-2, 9), "x") for _ in range(r.randint(1, 3))]) for q in sorted(queries)]


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    return Registry(spark, str(tmp_path_factory.mktemp("kbs")))


@pytest.fixture(scope="module")
def kb(spark, registry):
    return registry.register("trees", spark.createDataFrame(entries(), KIND), buckets=3, bloom=True)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plain(s, kb, size, pre_filter):
    """All windows, looked up one by one."""
    return fold_spans(candidates_by_window(windows(s, size, pre_filter), kb.entries))


@pytest.mark.parametrize("size, pre_filter", [(0, F.lower), (1, None), (3, no_the), (7, F.lower), (3, lambda w: F.lit(None).cast("string")), (4, lambda w: F.concat(F.lower(w), F.lit(" oak")))])
def test_growing_windows_find_the_same(spark, kb, size, pre_filter):
    s = sentences(spark)
    want = plain(s, kb, size, pre_filter)
    assert rows(match(s, kb, size, pre_filter)) == rows(want)
    assert rows(span_sizes_of(s, kb, size, pre_filter)) == rows(want.select("doc_id", "sent_idx", "start", "stop", F.size("candidates").alias("n_candidates")))
    hits = candidates_by_window(windows(s, size, pre_filter), kb.entries)
    assert rows(find_hits(s, kb, size, pre_filter)) == rows(hits.drop("query"))
    assert rows(large_hits(s, kb, size, pre_filter)) == rows(hits)


def test_larger_windows_are_looked_up_one_by_one(spark, kb):
    s = sentences(spark)
    assert rows(match(s, kb, 17, F.lower)) == rows(plain(s, kb, 17, F.lower))
    with pytest.raises(ValueError):
        hits_in_row(s, [Matcher(kb, 17)])


def test_best_in_row(spark, kb):
    s = sentences(spark)
    found = match(s, kb, 4, F.lower)
    for is_long, pick in ((True, longest), (False, shortest)):
        want = resolve(found, {"best": pick}).select("doc_id", "sent_idx", "start", "stop", "best")
        assert rows(best_in_row(s, Matcher(kb, 4, F.lower), "best", is_long)) == rows(want)


def test_spans_in_row_need_no_shuffle_and_few_windows(spark, kb, registry):
    s = split_sentences(from_strings(spark, "a b"))
    plan = match(s, kb, 4, F.lower)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Aggregate" not in plan and plan.count("BroadcastHashJoin") == 4
    few = registry.register("few", spark.createDataFrame([("red oak tree", [(1, "x")]), ("kew", [(2, "x")])], KIND))
    s = spark.createDataFrame([(0, 0, ["red", "oak", "tree", "of", "kew"])], "doc_id long, sent_idx int, words array<string>")
    assert [r["n_windows"] for r in windows_made(s, Matcher(few, 8)).orderBy("n_words").collect()] == [5, 1, 1, 0, 0, 0, 0, 0]


def test_matchers_share_a_pass(spark, kb, registry):
    s = sentences(spark)
    other = registry.register("other", spark.createDataFrame(entries(9), KIND))
    whole = [(kb, 4, F.lower), (other, 3, F.lower), (kb, 2, no_the), (other, 0, F.lower), (kb, 17, F.lower)]
    want = None
    for k, (b, size, f) in enumerate(whole):
        one = plain(s, b, size, f).withColumn("matcher_idx", F.lit(k))
        want = one if want is None else want.unionByName(one)
    assert rows(match_all(s, whole)) == rows(want)
    assert rows(match_all(s, whole[:2], 5)) == rows(want.where("matcher_idx < 2").withColumn("matcher_idx", F.col("matcher_idx") + 5))
    third = registry.register("typed", spark.createDataFrame([("oak", [("a",)])], "query string, responses array<struct<concept_id:string>>"))
    with pytest.raises(ValueError):
        spans_in_row(s, [Matcher(kb), Matcher(third)])


def test_pipeline_joins_its_matchers(spark, kb):
    docs = from_strings(spark, "Red oak. The old tree of Kew")
    line = Pipeline().add(load_texts(docs), "t").add(match_windows(kb, 1, F.lower), "a").add(match_windows(kb, 3, F.lower), "b")
    both = line.run()
    s = split_sentences(docs)
    want = plain(s, kb, 1, F.lower).unionByName(plain(s, kb, 3, F.lower).withColumn("matcher_idx", F.lit(1)))
    assert rows(both.spans) == rows(want) and both.matchers == 2
    plan = both.spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 2  # sentences and words, once for both
    line.add(process_words({"low": F.lower}), "w").add(match_windows(kb, 1, lambda w, meta: meta["low"]), "c")
    assert Counter(r["matcher_idx"] for r in line.run().spans.collect())[2] == want.where("matcher_idx = 0").count()


def test_registry(spark, registry, tmp_path):
    first = registry.register("Trees_en", spark.createDataFrame([("ash", [(1, "a"), None]), (None, [(2, "b")]), ("no", [None]), ("fir tall", [(3, None)])], KIND), buckets=2)
    assert (first.name, first.version, first.about["queries"], first.about["prefixes"]) == ("TREES_EN", 1, 2, 4) and first.small and first.filter is None
    second = registry.register("TREES_EN", spark.createDataFrame([("elm", [(4, "d")])], KIND))
    assert second.version == 2 and [r["query"] for r in registry.load("trees_EN").entries.collect()] == ["elm"]
    old = registry.load("trees_en", 1)
    assert sorted((r["query"], [c["concept_id"] for c in r["responses"]]) for r in old.entries.collect()) == [("ash", [1]), ("fir tall", [3])]
    assert sorted(registry.versions("trees_en")) == [1, 2] and registry.versions("nothing") == {}
    for bad in (None, "", "nowhere", "a/b"):
        with pytest.raises(ValueError):
            registry.load(bad)
    with pytest.raises(ValueError):
        registry.load("trees_en", 9)
    kind = "query string, responses array<struct<concept_id:int,kind:string>>"
    for faulty in ([("red", [(1, "a")]), ("red", [(2, "b")])], [("red", [(None, "a")])]):
        with pytest.raises(Exception, match="knowledge base"):
            registry.register("faulty", spark.createDataFrame(faulty, kind))
    assert registry.versions("faulty") == {}
    with pytest.raises(ValueError):
        registry.register("faulty", spark.createDataFrame([("a", 1)], "query string, responses int"))


def test_loaded_entries_are_not_checked_or_shuffled_again(spark, registry, kb):
    again = Registry(spark, registry.root).load("Trees")
    plan = again.entries._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    spark.sql(f"DROP TABLE {registry._table(kb.about)}")  # as in a new session; files stay
    again = Registry(spark, registry.root).load("Trees")
    s = sentences(spark)
    hits = large_hits(s, again, 3, F.lower)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows(hits) == rows(candidates_by_window(windows(s, 3, F.lower), again.entries))


def test_filters_stand_below_the_shuffle(spark, registry):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    s = spark.createDataFrame([(k, 0, [word() for _ in range(30)]) for k in range(300)], "doc_id long, sent_idx int, words array<string>")
    some = {w for x in s.collect() for w in x["words"][:3]} | {" ".join(x["words"][4:6]) for x in s.limit(100).collect()}
    kb = registry.register("many", spark.createDataFrame([(q, [(1, "x")]) for q in some], KIND), bloom=True)
    hits = large_hits(s, kb, 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(query") < plan.index("shiftright") and plan.count("BroadcastHashJoin") == 4
    n = candidates_by_window(windows(s, 4), kb.entries).count()
    assert n <= grown_windows(s, kb, 4).count() <= 1.2 * n and hits.count() == n
    with pytest.raises(ValueError):
        grown_windows(s, registry.register("plain", spark.createDataFrame(entries(), KIND)))


def test_hot_queries_are_salted(spark, kb):
    s = spark.createDataFrame([(k, 0, ["the"] * 40 + ["red"]) for k in range(200)], "doc_id long, sent_idx int, words array<string>")
    hot = hot_queries(s, kb, 2, F.lower)
    held = {r["query"]: r["salts"] for r in hot.collect()}
    assert held and max(held.values()) == 64
    hits = large_hits(s, kb, 2, F.lower, hot)
    assert rows(hits) == rows(large_hits(s, kb, 2, F.lower))
    assert "salt" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprints(spark, registry, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame(entries(), KIND).write.parquet(path)
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(path)

    one = registry.ensure("kept", fingerprint(spark, path), build)
    assert registry.ensure("Kept", fingerprint(spark, path), build).version == one.version == 1 and len(made) == 1
    assert registry.ensure("kept", fingerprint(spark, path), build, bloom=True).filter is not None
    spark.createDataFrame(entries(5, False), KIND).write.mode("overwrite").parquet(path)
    assert registry.ensure("kept", fingerprint(spark, path), build).version == 3


def test_stream_goes_on_after_a_restart(spark, kb, tmp_path):
    r = random.Random(6)
    docs = [(k, ". ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) for _ in range(3))) for k in range(40)]
    docs += [(100, None), (101, "")]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = []
    for part in (docs[:10], docs[10:30], docs[30:]):
        spark.createDataFrame(part, "doc_id long, text string").repartition(2).write.mode("append").parquet(source)
        stream = span_stream(stream_texts(spark, source, files_per_batch=1), [Matcher(kb, 4, lambda w, meta: meta["low"]), Matcher(kb, 2, F.lower)], {"low": F.lower}, {"best": longest})
        assert stream.isStreaming
        query = append_to(stream, out, state)
        query.awaitTermination(120)
        batches.append(len(query.recentProgress))
    got = spark.read.parquet(out)
    s = split_sentences(spark.createDataFrame(docs, "doc_id long, text string"))
    want = resolve(plain(s, kb, 4, F.lower).unionByName(plain(s, kb, 2, F.lower).withColumn("matcher_idx", F.lit(1))), {"best": longest})
    assert rows(got) == rows(want) and min(batches) >= 2


def test_streams_of_other_sources(spark, kb, tmp_path):
    path = str(tmp_path / "json")
    spark.createDataFrame([(1, "red oak")], "id long, body string").write.json(path)
    texts = stream_texts(spark, path, "json", "id", "body")
    assert texts.isStreaming and texts.columns == ["doc_id", "text"]
    assert stream_texts(spark, "", "rate", "value", "value", rowsPerSecond=1).isStreaming


def test_asked_functions(spark):
    s = sentences(spark)

    def ask(query):
        if query == "red oak":
            return [{"concept_id": "a"}, None, {}, {"concept_id": "b"}]
        return [{"concept_id": query[:1]}] if query.startswith("o") else [] if query == "kew" else None

    got = asked_hits(s, ask, 3, no_the)
    assert got.columns == ["doc_id", "sent_idx", "start", "stop", "responses"]
    answers = lambda q: [x for x in ask(q) or [] if x]
    want = [(r["doc_id"], r["sent_idx"], r["start"], r["stop"], [x["concept_id"] for x in answers(r["query"])]) for r in windows(s, 3, no_the).collect() if answers(r["query"])]
    assert sorted((*r[:4], [x["concept_id"] for x in r["responses"]]) for r in got.collect()) == sorted(want) and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan
    assert asked_hits(s, lambda q: None).count() == 0 and asked_hits(s.where("doc_id < 0"), ask).count() == 0


def test_documents_in_the_row(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b. ! c?"), (4, "one,two;three. four"), (5, ". |x| y")], "doc_id long, text string")
    s = split_sentences(docs)
    assert rows(texts_in_row(docs)) == rows(document_texts(docs, s))
    parts = {"1:-1": (1, -1), ":": (None, None), "-2:": (-2, None), "-1": -1, "0": 0, "2": 2, "-9": -9}
    got = parts_in_row(docs, parts)
    for name, part in parts.items():
        want = document_slice(s, *part) if isinstance(part, tuple) else document_item(s, part)
        assert rows(got.where(F.col("part") == name).drop("part")) == rows(want), name
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def best_set(spans, weight):
    """Of all sets without overlaps that of greatest weight; of equal ones that which takes the earlier span."""
    spans = sorted(spans)

    def best(at):
        rest = [s for s in spans if s[0] >= at]
        if not rest:
            return 0, []
        s = rest[0]
        w, chain = best(s[1])
        skip = best(s[0] + 1)
        return (w + weight(s), [s, *chain]) if w + weight(s) >= skip[0] else skip

    return best(0)[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_without_overlaps(spark, seed):
    r = random.Random(seed)
    data = {k: {a: a + r.randint(1, 5) for a in range(12) if r.random() < 0.6} for k in range(30)}
    df = spark.createDataFrame([(k, 0, a, z, {"m": "x"}) for k, spans in data.items() for a, z in spans.items()], "doc_id long, sent_idx int, start int, stop int, extra map<string,string>")
    for weight, column in ((lambda s: (s[1] - s[0]) ** 2, None), (lambda s: 1, lambda s: F.lit(1)), (lambda s: s[0] % 3, lambda s: s["start"] % 3)):
        got = without_overlaps(df, column) if column else without_overlaps(df)
        assert got.columns == df.columns
        want = sorted((k, *s) for k, spans in data.items() for s in best_set(spans.items(), weight))
        assert sorted((x["doc_id"], x["start"], x["stop"]) for x in got.collect()) == want


def test_overlaps_of_several_matchers(spark):
    df = spark.createDataFrame([(0, 0, 1, 0, 2), (0, 0, 0, 0, 2), (0, 0, 0, 0, 1), (0, 0, 0, 2, 2), (0, 0, 1, 1, 4)], "doc_id long, sent_idx int, matcher_idx int, start int, stop int")
    assert [tuple(r) for r in without_overlaps(df).collect()] == [(0, 0, 1, 1, 4)]
    flat = without_overlaps(df, lambda s: F.when(s["start"] == 0, 20).otherwise(1))
    assert [tuple(r) for r in flat.collect()] == [(0, 0, 0, 0, 1), (0, 0, 1, 1, 4)]
    assert without_overlaps(df.where("doc_id > 5")).collect() == []


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_span_sizes_of_a_frame(spark, kb):
    s, frame = sentences(spark), from_dict(spark, {"oak": [{"concept_id": 1}]})
    assert rows(span_sizes_of(s, frame, 2, F.lower)) == rows(span_sizes(find_hits(s, frame, 2, F.lower)))


@pytest.mark.parametrize("n", [1, 3])
def test_candidates_are_compiled(spark, kb, capsys, n):
    """No lambda makes a candidate, and no stage has a method that is too large for the JVM's compiler."""
    found = match_all(sentences(spark), [(kb, size, F.lower) for size in (4, 3, 2)[:n]])
    assert "lambdafunction(struct(" not in found._jdf.queryExecution().optimizedPlan().toString()
    capsys.readouterr()
    found.explain("codegen")
    assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


@pytest.mark.parametrize("start, size", [(0, 4), (2, 4), (2, 0), (8, 3), (-1, 2)])
def test_span_at_one_start_needs_no_shuffle(spark, kb, start, size):
    s = sentences(spark)
    found = find_span(s, kb, start, size, no_the)
    assert rows(found) == rows(find_span(s, kb.entries, start, size, no_the))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0


@pytest.mark.parametrize("resolver, want", [(longest, [2, 5]), (shortest, [0, 1])])
def test_candidates_of_several_starts_are_told_by_width(spark, resolver, want):
    c = "array<struct<start:int,stop:int,resp_idx:int,concept_id:int>>"
    spans = spark.createDataFrame([(1, 0, [(0, 1, 0, 1), (2, 5, 0, 2), (7, 8, 0, 3)]), (2, 0, [])], f"doc_id long, start int, candidates {c}")
    assert [(r["best"]["start"], r["best"]["stop"]) if r["best"] else None for r in resolve(spans, {"best": resolver}).orderBy("doc_id").collect()] == [tuple(want), None]


def test_asked_sentences_pass_in_batches(spark):
    """Sentences go to Python in Arrow batches; a number becomes text where text is asked for, a missing field is null."""
    s = spark.createDataFrame([(1, 0, ["oak", "tree"]), (2, 0, []), (3, 1, None)], "doc_id long, sent_idx int, words array<string>")
    got = asked_hits(s, lambda q: [{"concept_id": 7, "more": 1}, {}] if q == "oak tree" else None, 2, F.lower, "struct<concept_id:string,kind:string>")
    assert [(r["doc_id"], r["start"], r["stop"], [tuple(x) for x in r["responses"]]) for r in got.collect()] == [(1, 0, 2, [("7", None)])]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_window_counts_shuffle_a_start_once(spark):
    """Counts equal those of all windows, also with words left out and words that hold spaces, and no window is shuffled by itself."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["a", "b", "C", "c", "drop", "two"]) for _ in range(rng.randint(0, 9))) + ".") for i in range(60)]
    s = split_sentences(spark.createDataFrame(texts, "doc_id long, text string"))
    odd = lambda w: F.when(w == "two", "a b").when(w != "drop", F.lower(w))
    for pre_filter, size in ((F.lower, 4), (odd, 4), (odd, 1), (odd, 3), (None, 2), (F.lower, 0)):
        want = windows(s, size, pre_filter).groupBy("query").agg(F.count("*").alias("n"), F.min(F.col("stop") - F.col("start")).alias("n_words"))
        got = window_counts(s, size, pre_filter, 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = window_counts(s, 4, F.lower, 3)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ReusedExchange" in plan


def test_bucketed_hits_are_not_sorted_and_hot_queries_are_dealt(spark, kb):
    s = spark.createDataFrame([(k, 0, ["the"] * 40 + ["red", "oak", "tree", "of"]) for k in range(200)], "doc_id long, sent_idx int, words array<string>")
    hot = spark.createDataFrame([("the", 64), ("unknown", 1)], "query string, salts int")
    for some in (hot, hot.where("salts < 0")):
        hits = bucketed_hits(s, kb, some, 3, F.lower)
        assert rows(hits.select(large_hits(s, kb, 3, F.lower).columns)) == rows(large_hits(s, kb, 3, F.lower))
        assert sorted(map(tuple, span_sizes(hits, parts=5).collect())) == sorted(map(tuple, span_sizes(hits).collect()))
    plan = bucketed_hits(s, kb, hot, 3, F.lower)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_calm_sentences_need_no_folds(spark):
    """Spans that do not overlap are all kept, and only sentences with overlaps are folded; both stand in one table."""
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 3), (0, 0, 5, 6), (0, 1, 0, 2), (0, 1, 1, 4), (0, 2, 3, 4), (0, 3, 2, 2)], "doc_id long, sent_idx int, start int, stop int")
    got = without_overlaps(df)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 1), (0, 0, 1, 3), (0, 0, 5, 6), (0, 1, 1, 4), (0, 2, 3, 4)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN calm" in plan and "sort_array" in plan


def test_windows_of_large_lookups_are_not_filtered_by_lambdas(spark, kb):
    """A filter of the windows by a lambda was interpreted for each start."""
    s = sentences(spark)
    plan = grown_windows(s, kb, 4, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in plan
    assert large_hits(s, kb, 4).count() == candidates_by_window(windows(s, 4), kb.entries).count()
