import numpy as np
import pyarrow as pa
from brute import rows

from tablewright.llm import quality
from tablewright.llm.common import text_chunks


def chunk(texts):
    (_, data, offsets) = next(text_chunks(pa.array(texts, pa.string()), 1 << 30))
    return data, offsets


def test_pairwise_identity():
    """The linear-time margin equals the sum over all pairs of features."""
    draw = np.random.default_rng(2)
    model = quality.FactorisationMachine(0.3, draw.normal(size=quality.SIZE), draw.normal(size=(quality.SIZE, quality.FACTORS)))
    data, offsets = chunk(["good words of a text\nand a line", "", "GOOD!! $$$ GOOD!!"])
    x = quality.features(data, offsets, np.array([30.0, 0.0, 17.0]))
    for n, got in enumerate(model.margins(x, 3)):
        at, v = x.at[x.row == n], x.value[x.row == n]
        pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * v[i] * v[j] for i in range(len(at)) for j in range(i))
        assert np.isclose(got, 0.3 + model.linear[at] @ v + pairs)


def test_features_do_not_depend_on_the_chunk():
    texts = ["A b c b", None, "x\nx\n\ny", "", "É ÉÉ 12 #$"]
    data, offsets = chunk(texts)
    together = quality.features(data, offsets, np.zeros(5))
    for n, text in enumerate(texts):
        alone = quality.features(*chunk([text]), np.zeros(1))
        assert np.array_equal(together.at[together.row == n], alone.at)
        assert np.allclose(together.value[together.row == n], alone.value)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in quality.op2_quality(spark, sf_dir).collect()}
    assert sorted(found) == sorted(d for (d,) in rows(sf_dir, "documents", "doc_id"))
    marks = [(found[d], q) for d, q in rows(sf_dir, "labels", "doc_id, quality") if found[d].held_out]
    assert np.mean([r.predicted == q for r, q in marks]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_odd_rows(spark):
    texts = [None, "", " ", "fine words here", "fine words here", "x " * 100_000]
    df = spark.createDataFrame([(None if i == 1 else i, t, "s", None, "a") for i, t in enumerate(texts)], "doc_id long, text string, score string, n_chars long, lang string")
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, None), (99, None, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(df, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.text == "fine words here"}) == 1
    assert all(r.score == 0.5 for r in quality.classify(df, labels.limit(0)).collect())
    assert quality.classify(df.limit(0), labels).count() == 0


def test_the_driver_holds_features_as_they_arrive(spark, tiny, monkeypatch):
    """Four bytes a number, and the model that the wide copies of them gave."""
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows: seen.extend(rows) or fit(rows, 2))
    quality.op2_quality(spark, tiny)
    assert seen and all(a.dtype.itemsize == v.dtype.itemsize == 4 for _, a, v in seen)
    narrow, wide = fit(seen, 2), fit([(y, a.astype("int64"), v.astype("float64")) for y, a, v in seen], 2)
    assert narrow.bias == wide.bias and (narrow.linear == wide.linear).all() and (narrow.factors == wide.factors).all()
