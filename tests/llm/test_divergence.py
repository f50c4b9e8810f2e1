"""Operator 12 against plain counting, with awkward rows and small shards."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lexispan.llm import divergence
from lexispan.llm.divergence import source_divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, value long"


def rows():
    r = random.Random(11)
    words = ["the", "Of", "ünd", "niño", "a1b", "x_y", "naïve's", "ZÜRICH", "b", "cc", "ddd", "日本", "\U0001d400z"]
    data = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S3", "ß", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(160)]
    data += [("en", "big", "the " * 20000 + "Of\x00b"), ("en", "none", ""), ("fr", "a", "seul"), ("fr", "b", None), ("it", "only", "uno"), ("en", "s1", "the of"), ("en", "s1", "the of")]
    return [(k, t, lang, s, "clash", 1, 2) for k, (lang, s, t) in enumerate(data)]


def expected(data, least, top):
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    for lang, source in groups:
        kept = [w for w, n in docs[lang].items() if n >= least]
        held = {s: {w: counts[lang, s][w] for w in kept} for g, s in groups if g == lang}
        whole = {w: sum(h[w] for h in held.values()) for w in kept}
        share = lambda h, w, kept=kept: 1 + 10**9 * (h[w] + 5) // (sum(h.values()) + 5 * len(kept))
        mine = held[source]
        pairs = [(sum(abs(share(mine, w) - share(h, w)) for w in kept), s) for s, h in held.items() if s != source]
        terms = [(share(mine, w) - share(whole, w), w) for w in kept if mine[w] > 0 and share(mine, w) > share(whole, w)]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, small", [(3, 50, False), (2, 2, True), (10**6, 50, False)])
def test_equals_plain_counting(spark, monkeypatch, least, top, small):
    if small:  # many slices and shards
        monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
        monkeypatch.setattr(divergence, "SHARD_WORK", 40)
        monkeypatch.setattr(divergence, "SLICE_BYTES", 300)
    data = rows()
    got = source_divergence(spark.createDataFrame(data, DOCS).repartition(5), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(data, least, top)


def test_slices_of_texts():
    import pyarrow as pa

    texts = ["a b a", "", "c" * 50, "a", "b b"] * 4
    batch = pa.record_batch({"lang": ["x"] * 20, "source": ["s", "t"] * 10, "text": texts, "ends": pa.array([len(t) for t in texts], pa.int64())})
    limit, divergence.SLICE_BYTES = divergence.SLICE_BYTES, 20
    try:
        n, docs, slices = Counter(), Counter(), 0
        for b in divergence._count_texts(iter([batch, batch])):
            slices += 1
            for r in b.to_pylist():
                if r["term"]:
                    n[r["term"]] += r["n"]
                    docs[r["term"]] += r["docs"]
    finally:
        divergence.SLICE_BYTES = limit
    assert slices > 4 and n == Counter({"a": 24, "b": 24, "c" * 50: 8}) and docs == Counter({"a": 16, "b": 16, "c" * 50: 8})


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []
