import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import subjects
from ridgeline.llm.subjects import document_subjects

TERMS = {"music": "violin tempo chord sonata quartet bass scale drum".split(), "garden": "soil compost rose hose lawn shears bulb weed".split(), "law": "court clause tort appeal statute notary lease brief".split()}
REMARKS = ["arrived on a monday", "the colour is nice", "five of five from me", "my cousin has the same", "no manual was there"]


@pytest.fixture(scope="module")
def reviews(spark):
    r = random.Random(4)
    docs, truth = [], {}
    for k in range(900):
        own = r.sample(sorted(TERMS), r.choice([0, 1, 1, 1, 2]))
        parts = [f"the {r.choice(TERMS[s])} and the {r.choice(TERMS[s])} worked" for s in own for _ in range(3)] + r.sample(REMARKS, 2)
        other = sorted(set(TERMS) - set(own))
        if other and r.random() < 0.3:
            parts.append(f"it came in one parcel with a {r.choice(TERMS[r.choice(other)])}")
        if r.random() < 0.2:
            parts.append("the price is music to my ears")
        r.shuffle(parts)
        truth[k] = set(own)
        docs.append((k, None if k % 5 else "Title", ". ".join(parts), r.choice(["en", "EN ", "eng", None])))
    labels = [(k, s.upper() + " ", "x") for k, v in truth.items() if k % 6 == 0 for s in v] + [(3, None, None), (None, "law", None), (5, "nonsense", None), (99999, "law", None)]
    docs += [(5000, None, None, None), (5001, "", "", "de"), (None, "t", "the violin and the tempo worked", "en")]
    frames = spark.createDataFrame(docs, "doc_id bigint, title string, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string, labelled_by string"), spark.createDataFrame([(s, "about " + s) for s in TERMS], "subject string, description string")
    return frames, truth, document_subjects(*frames).collect()


def test_subjects_are_found_and_mentions_are_not(reviews):
    _, truth, rows = reviews
    got = {k: set() for k in truth}
    for r in rows:
        got[r.doc_id].add(r.subject)
    right = sum(got[k] == truth[k] for k in truth)
    assert right / len(truth) > 0.97
    assert {r.doc_id for r in rows} <= set(truth)


def split(title, text):
    batch = pa.RecordBatch.from_pydict({"title": [title], "text": [text]})
    ((_, w),) = subjects._documents(batch)
    cuts = [0, *w.cuts]
    return [[w.terms[k] for k in w.codes[a:b]] for a, b in zip(cuts, cuts[1:])]


def test_segments():
    assert split("A b. C", "d <br/> e! \n f") == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert split(None, None) == split("", " ... ") == []
    assert split("a", '"b" c; d <a href="x.y">e</a>') == [["a"], ["b"], ["c"], ["d", "e"]]


def test_every_word_has_a_row(spark, reviews):
    (docs, _, _), _, _ = reviews
    texts = docs.selectExpr("doc_id AS id", "lang", "title", "text")
    terms, counts = subjects._vocabulary(texts)
    packed = subjects._termed(texts.repartition(3), terms).collect()
    batches = [x for r in packed for x in subjects._unpacked(pa.RecordBatch.from_pydict({"weights": [bytes(r.weights)], "words": [bytes(r.words)]}))]
    rows = [SimpleNamespace(**r) for b in batches for r in b.to_pylist()]
    assert len(rows) == sum(r.n for r in packed) == docs.count() and len(counts) == len(terms) + subjects.SHARED
    words = {}
    for d in docs.collect():
        for s in split(d.title, d.text):
            for w in s:
                words.setdefault(w, set()).add((d.doc_id, d.text))
    assert all(words[w] and counts[k] == len(words[w]) for w, k in terms.items() if len(words[w]) > 3)
    assert all(r.ids is not None and sorted(set(r.ids)) == sorted(r.terms) and all(e <= len(r.ids) for e in r.ends) for r in rows)
    assert {max(r.ids, default=0) >= len(terms) for r in rows} <= {True, False}


def test_blocks_of_one_text_give_the_same_rows(spark, reviews, monkeypatch):
    (docs, _, _), _, _ = reviews
    batch = pa.RecordBatch.from_pandas(docs.select("title", "text").toPandas())
    whole = [[w.terms[k] for k in w.codes] for _, w in subjects._documents(batch)]
    monkeypatch.setattr("ridgeline.llm.words.BLOCK", 1)
    assert [x for _, w in subjects._documents(batch) for x in [w.terms[k] for k in w.codes]] == [x for ws in whole for x in ws]


def test_nothing_to_learn_from(spark, reviews):
    (docs, labels, areas), _, _ = reviews
    assert document_subjects(docs.limit(0), labels, areas).count() == 0
    assert document_subjects(docs, labels, areas.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, None, "x y", "en")] * 4, docs.schema)
    assert document_subjects(alone, labels.limit(0), areas).count() == 0


def test_model_is_bounded():
    assert (subjects.VOCABULARY + subjects.SHARED) * subjects.RANK * 4 < 64e6
