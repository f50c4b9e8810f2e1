"""Operator 13 against SQL on awkward rows, and on notices that were changed."""

import random
import re

import duckdb
import pandas as pd
import pytest

from lexispan.llm.licenses import BASE_PHRASES, NOTICES, scan_licenses, templates, words_of
from lexispan.llm.sql import licenses_sql

DOCS = "doc_id long, text string, label string, n_words int, n int, template int"
TEXTS = dict(reversed(NOTICES))


def rows():
    r = random.Random(3)
    noise = lambda n: " ".join(r.choice(["the", "of", "software", "License", "ünd", "rights", "General", "Public", "MIT"]) for _ in range(n))
    texts = [None, "", " \n", "MIT", "MIT License", "mit license general public license", "The MIT-License; MIT LICENSE", "GENERAL PUBLIC", "a\x00mit\x00license"]
    for label, text in NOTICES:
        w = text.split()
        cut, put = list(w), list(w)
        del cut[len(w) // 2]
        put.insert(len(w) // 2, "really")
        texts += [text, " ".join(cut), " ".join(put), noise(20) + " " + text + " " + noise(30), " ".join(w[: len(w) // 2])]
    texts += [noise(3000), noise(500) + NOTICES[0][1] + noise(500) + NOTICES[4][1], "all rights reserved " * 3000, NOTICES[2][1] * 40]
    out = [(k, t, "x", 1, 2, 3) for k, t in enumerate(texts)]
    return out + [out[9], out[9], (None, "MIT License", "x", 0, 0, 0), (None, "MIT License", "x", 0, 0, 0), (None, "apache license", "x", 0, 0, 0), (9, "general public license", "x", 0, 0, 0)]


def test_equals_sql_on_awkward_rows(spark):
    data = rows()
    got = scan_licenses(spark.createDataFrame(data, DOCS).repartition(3)).drop("spans").collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d[0] for d in data], dtype="Int64"), "text": [d[1] for d in data]}))
    want = con.execute(licenses_sql()).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_changed_notices(spark):
    mit = NOTICES[0][1]
    changed = mit.replace("free of charge", "without charge at all").replace("merge, ", "")
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    far = mit.replace(", subject", " " + "word " * 200 + "subject")
    texts = [mit, changed, half, TEXTS["gpl"], TEXTS["agpl"], "no license here", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", far]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert [got[k]["labels"] for k in range(8)] == ["mit", "mit", "", "gpl", "agpl,gpl", "", "cc-by-nc", "cc-by"]
    assert got[0]["score"] == 1.0 and 0.7 < got[1]["score"] < 1.0 and got[2]["score"] == 0.0 and got[5]["spans"] == []
    assert got[3]["n_base"] == 2 and got[3]["first_word"] == words_of(TEXTS["gpl"]).index("general")
    s = got[1]["spans"][0]
    assert (s["first_word"], s["label"], s["base"]) == (0, "mit", False)


def test_base_places_against_a_scan_of_words(spark):
    data = [(k, t) for k, t, *_ in rows() if k is not None]
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect())
    want = []
    for k, t in data:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        places = [(i, label) for label, p in BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((k, len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({a for _, a in places}))))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], -1 if r[3] is None else r[3]))


def test_own_templates_and_faults(spark):
    df = spark.createDataFrame([(1, "shared freely by us"), (2, "shared by us")], "id long, body string")
    got = {r["id"]: r["labels"] for r in scan_licenses(df, (("own", "shared freely"),), (), "id", "body").collect()}
    assert got == {1: "own", 2: ""}
    with pytest.raises(ValueError):
        templates((("own", "word"),))
    with pytest.raises(ValueError):
        scan_licenses(df)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
