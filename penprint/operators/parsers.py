"""Adapters from live parsers to parsed documents: one row for each text, in the form that :mod:`penprint.operators.syntax` reads.

A parser is loaded once in each partition, by a function that can be pickled. The libraries themselves are optional: what they
return is read by its attributes alone, so any object of that shape will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from penprint.operators.syntax import COUNTS

# Relations by which clauses and nominals are counted, and English labels of another scheme as universal ones.

DEPENDENT_CLAUSES = ("acl", "advcl", "ccomp", "csubj", "pcomp", "relcl", "xcomp")
COMPLEX_NOMINALS = ("acl", "appos", "nmod", "nummod")
UNIVERSAL = {
    "acomp": "xcomp", "agent": "obl", "attr": "xcomp", "auxpass": "aux", "csubjpass": "csubj", "dative": "iobj", "dobj": "obj", "intj": "discourse", "meta": "dep", "neg": "advmod", "npadvmod": "obl", "nsubjpass": "nsubj",
    "oprd": "xcomp", "pcomp": "ccomp", "pobj": "obl", "poss": "nmod", "preconj": "cc", "predet": "det", "prep": "case", "prt": "compound", "quantmod": "advmod", "relcl": "acl",
}
_TOKEN = pa.struct([("text", pa.string()), ("upos", pa.string()), ("morphology", pa.list_(pa.struct([("attribute", pa.string()), ("value", pa.string())])))])
_ARC = pa.struct([("head", pa.int32()), ("dep", pa.int32()), ("relation", pa.string())])
_ENTITY = pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SCHEMA = (
    "tokens array<struct<text:string,upos:string,morphology:array<struct<attribute:string,value:string>>>>, arcs array<struct<head:int,dep:int,relation:string>>, "
    "entities array<struct<text:string,label:string,start:int,end:int>>, " + ", ".join(f"{c} long" for c in COUNTS)
)


def _counts(relations: Sequence[str], upos: Sequence[str], sentences: int) -> dict[str, int]:
    clauses = sum(r in DEPENDENT_CLAUSES for r in relations)
    return {
        "word_count": len(relations), "sentence_count": sentences, "clause_count": sentences + clauses, "t_unit_count": max(1, sentences), "dependent_clause_count": clauses, "coordinate_phrase_count": sum(r == "conj" for r in relations),
        "complex_nominal_count": sum(r in COMPLEX_NOMINALS for r in relations), "verb_phrase_count": sum(u == "VERB" for u in upos),
    }


def _morphology(given: str | dict) -> list[dict[str, str]]:
    """``Case=Nom|Number=Sing``, or the same as a dictionary."""
    pairs = given.items() if isinstance(given, dict) else (x.split("=", 1) for x in (given or "").split("|") if "=" in x)
    return [{"attribute": k, "value": str(v)} for k, v in pairs]


def from_spacy(doc) -> dict:
    """A document of tokens with ``head``, ``pos_``, ``dep_`` and ``morph``, with ``ents`` and ``sents``. Relations become universal ones; clauses are counted by the parser's own."""
    tokens = list(doc)
    return {
        "tokens": [{"text": t.text, "upos": t.pos_, "morphology": _morphology(m.to_dict() if hasattr(m := t.morph, "to_dict") else str(m))} for t in tokens],
        "arcs": [{"head": None if t.head.i == t.i else t.head.i, "dep": t.i, "relation": UNIVERSAL.get(t.dep_.lower(), t.dep_.lower())} for t in tokens],
        "entities": [{"text": e.text, "label": e.label_, "start": e.start, "end": e.end} for e in doc.ents],
        **_counts([t.dep_ for t in tokens], [t.pos_ for t in tokens], sum(1 for _ in doc.sents)),
    }


def from_stanza(document) -> dict:
    """A document of sentences, whose words count from 1 and whose entities lie by characters; places here run through the document."""
    words, arcs = [], []
    for sentence in document.sentences:
        before = len(words)
        for w in sentence.words:
            arcs.append({"head": before + w.head - 1 if w.head else None, "dep": before + w.id - 1, "relation": w.deprel.lower()})
        words += sentence.words
    entities = []
    for e in (e for sentence in document.sentences for e in sentence.ents):
        inside = [i for i, w in enumerate(words) if w.start_char < e.end_char and w.end_char > e.start_char]
        if inside:
            entities.append({"text": e.text, "label": e.type, "start": inside[0], "end": inside[-1] + 1})
    return {
        "tokens": [{"text": w.text, "upos": w.upos, "morphology": _morphology(w.feats)} for w in words], "arcs": arcs, "entities": entities,
        **_counts([w.deprel.lower() for w in words], [w.upos for w in words], len(document.sentences)),
    }


def spacy_parser(model: str) -> Callable[[], Callable[[str], dict]]:
    """A loader for :func:`parse_documents`; ``ImportError`` on the executors where the library isn't there."""
    def load() -> Callable[[str], dict]:
        import spacy

        pipeline = spacy.load(model)
        return lambda text: from_spacy(pipeline(text))
    return load


def stanza_parser(language: str) -> Callable[[], Callable[[str], dict]]:
    def load() -> Callable[[str], dict]:
        import stanza

        pipeline = stanza.Pipeline(language, processors="tokenize,pos,lemma,depparse,ner", verbose=False)
        return lambda text: from_stanza(pipeline(text))
    return load


def parse_documents(docs: DataFrame, parser: Callable[[], Callable[[str], dict]], id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """``doc_id``, tokens, arcs, entities and counts of every text; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"tokens": pa.list_(_TOKEN), "arcs": pa.list_(_ARC), "entities": pa.list_(_ENTITY)} | dict.fromkeys(COUNTS, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = None
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                parse = parse or parser()
                found = [parse(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[c] for f in found], k) for c, k in types.items())], ["doc_id", *types])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
