import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penprint.llm import quality as Q


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_features_are_finite(text):
    x = Q.features(text)
    assert len(x) == len(Q.FEATURES) and all(map(math.isfinite, x))


def prose(rng, n=80):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng, n=80):
    kind = rng.randrange(3)
    words = prose(rng, n).split()
    return " ".join(w + "***" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join([words[0]] * n)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < (0.9 if i % 3 else 0.5)
        docs.append((i, prose(rng) if good else junk(rng), "en", f"s{i % 3}", "x"))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    more = [(1000, None, None, None, "x"), (1001, "", "en", "s0", "x"), (None, prose(rng), "de", None, "x"), (1002, prose(rng, 50_000), "fr", "new", "x"), (1002, junk(rng), "fr", "new", "x"), (0, *docs[0][1:])]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, lang string, source string, accepted string")
    return d.withColumnRenamed("accepted", "extra"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (99_999, 1, 0), (0, labels[0][1], 0)], "doc_id long, quality int, toxic int"), docs, len(docs) + len(more)


def test_held_out_accuracy_and_edges(spark, tables):
    d, labels, docs, n = tables
    got = Q.judge(d, labels).collect()
    assert len(got) == n and all(r.quality is not None and 0 <= r.quality <= 1 for r in got)
    truth = {i: not ("***" in t or " | " in t or len(set(t.split())) == 2 or len(set(t.lower().strip(".").split())) < 5) for i, t, *_ in docs}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2]
    assert np.mean([r.accepted == truth[r.doc_id] for r in held]) >= 0.97
    assert [r.accepted for r in got if r.doc_id == 1002 and len(r.text) > 200_000] == [True]
    again = {(r.doc_id, r.text): r.quality for r in Q.judge(d.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id, r.text] - r.quality) < 1e-9 for r in got)


def test_sparse_sites_shrink_more(spark):
    rows = [("a", "x", 3.0)] * 400 + [("b", "x", -3.0)] * 200 + [("c", "x", -3.0)] * 1 + [("", "", 0.5)]
    got = {r.host: r["shift"] for r in Q.site_priors(spark.createDataFrame(rows, "host string, path string, x double")).collect()}
    assert got["a"] > 0 > got["c"] > got["b"]


def test_without_labels_nothing_is_rejected(spark, tables):
    d, labels, _, n = tables
    for given_labels in (labels.limit(0), labels.where("quality = 1")):
        got = Q.judge(d, given_labels).collect()
        assert len(got) == n and all(r.accepted and r.quality is None for r in got)
    assert Q.judge(d.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["evidence", "site", "quality", "accepted", "shift", "host", "path", "known", "x", "i", "y", "h", "n", "s", "__text", "__x", "__host", "__path", "__c0", "__a", "a.b"])
def test_clashing_names(spark, tables, name):
    d, labels, _, n = tables
    d = d.where("doc_id < 40").withColumnRenamed("extra", name)
    want = {r.doc_id for r in Q.judge(d.drop(f"`{name}`") if "." not in name else d.select("doc_id", "text", "lang", "source"), labels).where("accepted").collect()}
    got = Q.judge(d, labels)
    assert len(set(got.columns)) == len(got.columns) and {r["doc_id"] for r in got.collect() if r["accepted"]} == want
    rows = Q.accepted_rows(d, labels)
    assert rows.columns == d.columns and {(r["doc_id"], r[name]) for r in rows.collect()} == {(i, "x") for i in want}


def test_repeated_ids_stay_within_the_sample(spark):
    rng = random.Random(9)
    d = spark.createDataFrame([(i % 4, prose(rng) if i % 2 else junk(rng)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    one, two = (Q.fit(x, labels, 60) for x in (d, d.repartition(7)))
    assert one == two and one is not None
