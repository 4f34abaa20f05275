import random
from collections import Counter

import corpus_pipeline as P
from penprint.llm import mixing


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def test_mixed_rows_agree_with_the_mix(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 30)), "en", f"s{rng.randrange(3)}" if i % 7 else None, 1) for i in range(300)]
    rows += [(900, "again and again", "en", "s0", 1)] * 5 + [(None, "no id here", "en", "s1", 1)] * 2 + [(901, None, "en", "s2", 1), (902, "", "en", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int").repartition(4)
    want = Counter()
    for r in mixing.mix_sources(df).collect():
        if r["size"]:
            want[r["doc_id"], r["size"]] += r["taken"] // r["size"]
    got = Counter((r["doc_id"], len(r["text"].split())) for r in mixing.mixed_rows(df).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed_rows(df).columns == df.columns
    assert mixing.mixed_rows(df.limit(0)).collect() == []


def test_rows_that_straddle_a_cut(spark):
    df = spark.createDataFrame([(1, "one two three", "en", "a", 0)] * 7, "doc_id long, text string, lang string, source string, n_chars long")
    taken = sum(r["taken"] for r in mixing.mix_sources(df).collect())
    assert mixing.mixed_rows(df).count() * 3 == taken > 21


def test_stages_with_clashing_names(spark, tmp_path):
    rng = random.Random(6)
    names = ["accepted", "__key", "__id", "__t", "__r", "key", "k", "__size", "__times", "rank_hash", "kept", "a.b"]
    rows = [(i, prose(rng, 80), "en", f"s{i % 2}", 1) for i in range(12)] + [(20, "# | " * 40, "en", "s0", 1), (21, "# | " * 30, "en", "s1", 1)]
    rows += [(30, rows[0][1], "en", "s0", 1), (None, None, None, None, None)]
    d = spark.createDataFrame([(*r, *[f"{c} {r[0]}" for c in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame([(i, int(i < 20)) for i in (*range(12), 20, 21)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = d
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns
        for r in now.collect():
            assert [r[c] for c in names] == [f"{c} {r['doc_id']}" for c in names]
    assert P.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count() > 0


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    shared, line = prose(rng, 120), "\n" + prose(rng, 40) + "\n"
    assert len(line) > 202
    docs = [(i, prose(rng, 80), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[0][1], "en", "s0") for i in range(4)] + [(200, docs[1][1] + " tail", "en", "s1"), (300, prose(rng, 60) + shared + prose(rng, 60), "en", "s2"), (301, prose(rng, 60) + shared + prose(rng, 60), "en", "s1")]
    docs += [(400 + i, " ".join(w + "***" for w in prose(rng, 60).split()), "en", f"s{i % 3}") for i in range(30)] + [(500, None, None, None), (501, "", "en", "s0")]
    docs += [(310 + i, prose(rng, 150) + line + prose(rng, 150), "en", "s0") for i in range(2)]
    labels = [(d[0], int("***" not in (d[1] or "")), 0) for d in docs if d[0] % 2 == 0 and d[0] < 500]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != "tokens":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in seen["quality"]}
    assert kept >= {d[0] for d in docs if d[1] and "***" not in d[1]} and not kept & {400 + i for i in range(30)}
    ids = [r.doc_id for r in seen["near_dedup"]]
    assert len(ids) == len(set(ids)) and len({0, 100, 101, 102, 103} & set(ids)) == 1 and len({1, 200} & set(ids)) == 1 and {300, 301} <= set(ids)
    texts = {r.doc_id: r.text for r in seen["substring_dedup"]}
    # a passage goes, a line that occurs again stays
    assert shared[:200] not in texts[300] and shared[:200] not in texts[301] and texts[5] == docs[5][1]
    assert all(texts[d[0]] == d[1] for d in docs if d[0] in (310, 311))
    assert len(seen["tokens"]) == len(seen["mix"]) > 0
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in seen["tokens"]}
