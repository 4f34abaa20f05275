import json
from types import SimpleNamespace as N

import pytest

from penprint.judged import annotations as A
from penprint.judged import client as C
from penprint.operators import matches, parsers, syntax
from penprint.plans.view import document_view

CONFIG = C.Configuration("https://host.example/v1", "m", retries=2, context_window=100, delay=0.5)


def client(*answers, config=CONFIG):
    given, asked, slept = list(answers), [], []

    def transport(method, url, headers, body, timeout):
        asked.append((method, url, body))
        x = given.pop(0)
        if isinstance(x, Exception):
            raise x
        return x
    made = C.Client(config, transport, slept.append)
    return made, asked, slept


def said(content="{}", **more):
    return 200, json.dumps({"choices": [{"message": {"content": content, **more}, "finish_reason": more.pop("finish", "stop")}]})


def test_configuration():
    assert C.configuration({"base_url": "http://h", "model": "m"}).max_tokens == 32_768
    for bad in ({}, {"base_url": "http://h"}, {"base_url": "ftp://h", "model": "m"}, {"base_url": "http://h", "model": "m", "other": 1}, {"base_url": "http://h", "model": "m", "context_percent": 101}, {"base_url": "http://h", "model": "m", "retries": -1}):
        with pytest.raises(ValueError):
            C.configuration(bad)


def test_retries_and_failures():
    made, asked, slept = client((503, ""), TimeoutError(), said("yes"))
    assert made([{"role": "user", "content": "x"}]) == "yes" and len(asked) == 3 and slept == [0.5, 0.5] and asked[0][1] == "https://host.example/v1/chat/completions"
    for answers, why, n in (
        ([(404, "")], "request_error:404", 1), ([(500, "")] * 3, "server_error:500", 3), ([TimeoutError()] * 3, "timeout", 3), ([OSError()] * 3, "no_connection", 3), ([(200, "x")], "answer_is_not_json", 1), ([(200, "{}")], "no_choices", 1),
        ([said("a", refusal="no")], "refusal", 1), ([said("a", finish="length")], "truncated", 1), ([said(" ")], "empty_answer", 1),
    ):
        made, asked, _ = client(*answers)
        with pytest.raises(C.ClientError, match=why):
            made([{"role": "user", "content": "x"}])
        assert len(asked) == n
    made, asked, _ = client()
    with pytest.raises(C.ClientError, match="context_window_exceeded"):
        made([{"role": "user", "content": "x" * 361}])
    assert not asked
    assert client((200, json.dumps({"data": [{"id": "a"}, {"id": "b"}]})))[0].list_models() == ["a", "b"]


def test_embeddings(spark):
    made, asked, _ = client((200, json.dumps({"data": [{"index": 1, "embedding": [2, 3]}, {"index": 0, "embedding": [0, 1]}]})))
    assert made.embed_texts(["a", "b"]) == [[0.0, 1.0], [2.0, 3.0]] and made.embed_texts([]) == []
    for bad in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": []}]):
        with pytest.raises(C.ClientError):
            client((200, json.dumps({"data": bad})))[0].embed_texts(["a", "b"])

    def load():
        def transport(method, url, headers, body, timeout):
            texts = json.loads(body)["input"]
            if "bad" in texts:
                return 400, ""
            return 200, json.dumps({"data": [{"index": i, "embedding": [len(t), 1]} for i, t in enumerate(texts)]})
        return C.Client(CONFIG, transport)
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "bad")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.vector, r.reason) for r in C.embed(docs, load, batch=1).collect()}
    assert got == {1: ([3.0, 1.0], None), 2: (None, "empty_text"), 3: (None, "empty_text"), 4: (None, "request_error:400")}


def test_audit_fakes_and_columns(spark):
    name = next(n for n, t in A.TEMPLATES.items() if t.kind == "score")
    rows = spark.createDataFrame([(1, name, "q1", 0.2), (1, name, "q2", 0.4), (2, name, "q1", 0.5)], "doc_id long, feature string, request string, value double")
    got = {r.doc_id: (r.variants, r.variance) for r in A.paraphrase_audit(rows).collect()}
    assert got[1] == (2, pytest.approx(0.01)) and got[2] == (1, 0.0)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    fakes = A.fake_annotations(docs, rows.select("doc_id", "feature", "value"), (name,))
    assert {r.doc_id: (r.value, r.reason) for r in fakes.collect()} == {1: (None, "annotated_twice"), 2: (0.5, None), 3: (None, "not_annotated")}
    with pytest.raises(ValueError):
        A.fake_annotations(docs, rows, ("none",))
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "doc_id long, vector array<double>")
    assert [tuple(r) for r in A.vector_columns(v, "f", 2).orderBy("doc_id").collect()] == [(1, 1.0, 2.0), (2, None, None)]
    with pytest.raises(Exception, match="vector of width 2, not 3"):
        A.vector_columns(v, "f", 3).collect()


def test_adapters(spark):
    # made here, so that workers get it by value
    class Doc(list):
        pass

    def spacy_like(text):
        doc = Doc(N(i=i, text=w, pos_="VERB" if w == "ran" else "NOUN", dep_="ROOT" if w == "ran" else ("nsubjpass" if i == 0 else "relcl"), morph="Number=Sing|Case=Nom" if i == 0 else "") for i, w in enumerate(text.split()))
        root = next((t for t in doc if t.text == "ran"), None)
        for t in doc:
            t.head = root if root is not None else t
        doc.ents, doc.sents = ([N(text="Ann", label_="PERSON", start=0, end=1)] if doc else []), ([1] if doc else [])
        return doc

    docs = spark.createDataFrame([(1, "Ann ran home"), (2, None)], "doc_id long, text string")
    rows = parsers.parse_documents(docs, lambda: lambda text: parsers.from_spacy(spacy_like(text)))
    got = {r.doc_id: r for r in syntax.check_parsed(rows).collect()}
    one = got[1]
    assert [(a.head, a.dep, a.relation) for a in one.arcs] == [(1, 0, "nsubj"), (None, 1, "root"), (1, 2, "acl")] and [(m.attribute, m.value) for m in one.tokens[0].morphology] == [("Number", "Sing"), ("Case", "Nom")]
    assert (one.word_count, one.sentence_count, one.clause_count, one.verb_phrase_count, one.dependent_clause_count) == (3, 1, 2, 1, 1) and one.entities[0].label == "PERSON"
    assert (got[2].word_count, got[2].t_unit_count, got[2].tokens) == (0, 1, [])
    word = lambda i, t, head, rel, at, upos="NOUN": N(id=i, text=t, head=head, deprel=rel, upos=upos, feats="Case=Nom" if i == 1 else None, start_char=at, end_char=at + len(t))
    document = N(sentences=[N(words=[word(1, "Ann", 2, "nsubj", 0), word(2, "ran", 0, "root", 4, "VERB")], ents=[N(text="Ann", type="PER", start_char=0, end_char=3)]), N(words=[word(1, "Bo", 2, "conj", 9), word(2, "sat", 0, "root", 12, "VERB")], ents=[N(text="x", type="MISC", start_char=50, end_char=51)])])
    found = parsers.from_stanza(document)
    assert [(a["head"], a["dep"]) for a in found["arcs"]] == [(1, 0), (None, 1), (3, 2), (None, 3)] and found["entities"] == [{"text": "Ann", "label": "PER", "start": 0, "end": 1}]
    assert found["coordinate_phrase_count"] == 1 and found["clause_count"] == 2 and found["verb_phrase_count"] == 2


def test_match_records(spark):
    text = "However, it's e.g. NASA; however. I can't see U.S.A. in B2B"
    view = document_view(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    got = sorted((r.token_index, r.token, r.expansion, r.ambiguous, r.warning) for r in matches.contraction_matches(view).collect())
    assert got[0][1:] == ("it's", "it is", True, "ambiguous_contraction_expansion") and got[1][1:] == ("can't", "can not", False, None)
    phrases = [(r.item_id, r.start, r.end, r.text, r.polyfunctional) for r in matches.phrase_matches(view, "discourse_markers").orderBy("start").collect()]
    assert phrases == [("however", 0, 7, "However", True), ("however", 25, 32, "however", True)]
    spots = [(r.kind, r.start, r.end, r.text) for r in matches.abbreviation_matches(view).collect()]
    assert all(text[a:b] == t for _, a, b, t in spots) and {("acronym_class", 19, 23, "NASA"), ("abbreviation", 14, 18, "e.g.")} <= set(spots)
    assert {t for k, _, _, t in spots if k == "acronym_class"} >= {"NASA", "U.S.A.", "B2B"}
    records = {r.token: (r.token_count, r.band, r.in_reference, r.rank) for r in matches.sophistication_records(document_view(spark.createDataFrame([(1, "The the science zzz")], "doc_id long, text string"))).collect()}
    assert records == {"the": (2, "high_frequency", True, 1), "science": (1, "mid_frequency", True, 900), "zzz": (1, "out_of_reference", False, None)}
