import numpy as np
from brute import rows

from tablewright.llm import toxicity


def test_windows_cover_every_word():
    text = "It's a LONG " + "x" * 100 + " é1\n."
    assert b"".join(toxicity.windows(text.encode())) == b"itsalong" + b"x" * 100 + "é1".encode()
    assert toxicity.windows(b"") == []


def test_a_word_of_the_toxic_dictionary_is_nearer_to_it():
    model = toxicity.CompressionModel(b" the  quiet  garden " * 5, b" vile  horrid  nasty " * 5, np.zeros(5))
    near = toxicity.Distances(model)
    assert near.measures(b"a Horrid garden")[0] > 0.4
    assert near.measures(b"the quiet garden unseen")[0] == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf_dir).collect()}
    assert sorted(found) == sorted(d for (d,) in rows(sf_dir, "documents", "doc_id"))
    marks = [(found[d], q) for d, q in rows(sf_dir, "labels", "doc_id, toxic") if found[d].held_out]
    assert np.mean([r.predicted == q for r, q in marks]) > 0.94
    assert np.mean([r.predicted for r, q in marks if q]) > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_odd_rows(spark):
    texts = [None, "", " ", "vile words", "vile words", "x " * 100_000, "kind words"]
    df = spark.createDataFrame([(None if i == 1 else i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (99, None), (6, 0)], "doc_id long, toxic int")
    found = toxicity.classify(df, labels).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.text == "vile words"}) == 1
    assert all(r.score == 0.5 for r in toxicity.classify(df, labels.limit(0)).collect())
    assert toxicity.classify(df.limit(0), labels).count() == 0
