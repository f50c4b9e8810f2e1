"""Operator 11 against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lexispan.llm.spelling import Trie, changed_words, spelling_groups
from lexispan.llm.sql import spelling_sql

DOCS = "doc_id long, text string, word string, n long, form string, run string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "abcdéÿ", "a日\U0001d400"])
def test_automata_meet_tries(letters):
    r = random.Random(letters)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 9))) for _ in range(400)})
    counts = [r.randint(1, 10**12) for _ in words]
    halves = [Trie.of(words[:150], counts[:150]), Trie.of(words[150:], counts[150:])]
    halves = [Trie.from_row(t.to_row()) for t in halves]
    for w in words[::5] + ["", letters[0] * 30, letters[-1] * 8 + "zz"]:
        got = sorted(x for t in halves for x in t.near(w))
        assert got == sorted((n, x) for n, x in zip(counts, words) if one_apart(w, x)), w
    assert Trie.of([], []).near("a") == [] and Trie.of(["a"], [3]).near("") == [(3, "a")]


def rows():
    r = random.Random(4)
    stems = ["letter", "colour", "aaaaa", "straße", "niños", "gross"]

    def word():
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = w[:i] + r.choice(["", "e", "ß", "a"]) + w[i + r.randint(0, 1) :]
        return r.choice([w, w, w.upper(), w.title()])

    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "x1y2", "ABCDE" * 20000, "tausend " * 5000, "tausent tausent tausent", "tausand-tausand/tausand", "÷×abcd ÷×abcd ÷×abcd"]
    data = [(k, t, "w", 1, "f", "r") for k, t in enumerate(texts)]
    return data + data[:2] + [(None, "colour letter", "w", 1, "f", "r")] * 2


def expected(data, every=97):
    counts = Counter()
    for k, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, near = {}, {}
    for w in words:
        found = sorted((-words[x], x) for x in words if one_apart(w, x))
        near[w] = len(found)
        forms[w] = found[0][1] if found and -found[0][0] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near[w], words.get(forms[w])))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("shard_words, round_bytes, every", [(None, None, 97), (60, 3000, 5)])
def test_equals_plain_comparison(spark, shard_words, round_bytes, every):
    data = rows()
    df = spark.createDataFrame(data, DOCS).repartition(4)
    got = spelling_groups(changed_words(df, every=every), shard_words=shard_words, round_bytes=round_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(data, every)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == want
    assert len({w[2] for w in want}) < len(want) and any(w[1] != w[2] for w in want if w[1])


def test_sql_says_the_same():
    data = [d for d in rows() if len(d[1] or "") < 50_000 or " " in d[1]]  # the checksum of a very long run is slow in SQL
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d[0] for d in data], dtype="Int64"), "text": [d[1] for d in data]}))
    assert sorted(con.execute(spelling_sql()).fetchall(), key=lambda x: x[0]) == expected(data)


def test_chains_are_followed_to_the_end(spark):
    chain = [("abcde" + "x" * k, 3 * 2**k) for k in range(9)]  # each is one letter from the next, which is twice as frequent
    words = spark.createDataFrame([(w,) for w, n in chain for _ in range(n)], "word string")
    got = {r["word"]: r for r in spelling_groups(words).collect()}
    assert all(got[w]["root"] == chain[-1][0] for w, _ in chain) and got[chain[0][0]]["form"] == chain[1][0] and got[chain[-1][0]]["form"] is None


def test_empty(spark):
    assert spelling_groups(changed_words(spark.createDataFrame([], DOCS))).collect() == []
    assert spelling_groups(changed_words(spark.createDataFrame([(1, "abc abc abc")], "doc_id long, text string"))).collect() == []
