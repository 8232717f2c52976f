import random
from collections import Counter

import pytest

import corpus_pipeline
from test_packing import check, plain_pieces
from test_secret_scan import plain as plain_secrets

from tablewright.llm import mixing, simhash


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    sf_dir = "/root/testdata/sf0.01"
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    return sf_dir, frames


def test_stages_keep_columns_and_take_effect(spark, stages):
    sf_dir, frames = stages
    docs, good, single, clean, mixed, packed = frames
    for frame in frames[1:-1]:
        assert frame.columns == docs.columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(d in kept for d, q in quality.items() if q) >= 0.98 * sum(quality.values())
    assert sum(d in kept for d, q in quality.items() if not q) <= 0.2 * sum(1 - q for q in quality.values())
    assert not any(k < 2 and s for r in clean.collect() for k, s in enumerate(plain_secrets(r.text)[0][:3]))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()}
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    expected = {r.doc_id: r.k for r in clean.select("doc_id", mixing.poisson_count(mixing.F.lit(1.0), mixing.F.lit("x")).alias("k")).limit(1).collect()}
    assert expected and mixed.count() > 0
    check(packed.collect(), plain_pieces([(r.doc_id, r.text) for r in mixed.collect()]))


def shingles(text, words=5):
    found = text.encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def test_near_copies_go_and_others_stay(stages):
    _, good, single, *_ = stages[1]
    sets = {r.doc_id: shingles(r.text) for r in good.collect()}
    kept = {r.doc_id for r in single.collect()}
    holders, shared = {}, Counter()
    for doc, found in sets.items():
        for s in found:
            for other in holders.setdefault(s, []):
                shared[other, doc] += 1
            holders[s].append(doc)
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    close = [p for p, j in alike.items() if j >= 0.85]
    assert sum(a in kept and b in kept for a, b in close) <= 0.05 * len(close)
    near = {d for p, j in alike.items() if j >= 0.7 for d in p}
    lost = [d for d in sets if d not in near and d not in kept]
    assert not lost, [(d, len(sets[d]), max((j for p, j in alike.items() if d in p), default=0)) for d in lost]


def test_groups_of_odd_rows(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    near = list(base)
    near[100], near[300] = "new", "other"
    docs = [(4, " ".join(base)), (2, " ".join(near)), (9, " ".join(base).upper()), (7, None), (5, ""), (6, "a b"), (6, "a b"), (None, "a  B"), (8, "x " * 50_000), (None, "only here")]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, component string, print int")
    found = sorted(((r.doc_id, r.component) for r in simhash.similar_groups(df).collect()), key=repr)
    assert found == sorted([(4, 2), (2, 2), (9, 2), (7, 5), (5, 5), (6, 6), (6, 6), (None, 6), (8, 8), (None, None)], key=repr)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((d or 0, t) for d, t in [docs[1], docs[4], docs[5], docs[8], docs[9]])
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_links_are_decided_by_the_exact_similarity(spark):
    draw, docs, expected = random.Random(11), [], {}
    for k in range(300):
        base = [f"w{draw.randrange(10**9)}" for _ in range(604)]
        near = list(base)
        for place in range(20, 580, 25)[: draw.choice((12, 13, 14))]:
            near[place] = "changed"
        if k % 3:
            near += [f"v{draw.randrange(10**9)}" for _ in range(draw.randrange(25))]
        one, other = shingles(" ".join(base)), shingles(" ".join(near))
        expected[2 * k] = len(one & other) / len(one | other)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = {d: found[d + 1] == d for d in expected}
    below = [d for d, j in expected.items() if 0.77 <= j < 0.8]
    above = [d for d, j in expected.items() if 0.8 <= j < 0.83]
    print(len(below), sum(linked[d] for d in below), len(above), sum(linked[d] for d in above))
    assert len(below) > 50 and not any(linked[d] for d in below)
    assert len(above) > 50 and sum(linked[d] for d in above) >= 0.85 * len(above)


def test_no_link_is_left_out(spark):
    """Short texts at the limit itself, among texts that share a common line, and a text between two groups."""
    draw, docs, expected = random.Random(23), [], set()
    line = [f"c{k}" for k in range(30)]
    for k in range(400):
        base = [f"w{draw.randrange(10**9)}" for _ in range(draw.choice((9, 14, 29)))]
        base = base + line if k % 4 == 0 else base
        near = base[: -((len(base) - 4) // 5)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets = {d: shingles(t) for d, t in docs}
    for k in range(400):
        one, other = sets[2 * k], sets[2 * k + 1]
        if len(one & other) / len(one | other) >= 0.8:
            expected.add(2 * k)
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(expected) > 300
    assert [d for d in expected if found[d + 1] != d] == []
    assert all(found[d] == d for d in sets if d % 2 == 0)


def test_a_group_of_copies_that_are_not_near_leaves_no_pairs(spark, monkeypatch):
    """Texts are read once for their prefixes, and a group's pairs below the limit are ruled out where they meet."""
    draw = random.Random(31)
    base = [f"w{draw.randrange(10**9)}" for _ in range(150)]
    docs = []
    for d in range(150):
        words = list(base)
        for place in draw.sample(range(0, 150, 5), 5 + d % 3):
            words[place] = f"v{draw.randrange(10**9)}"
        docs.append((d, " ".join(words)))
    sets = {d: shingles(t) for d, t in docs}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    near = sum(j >= 0.75 for j in alike.values())
    assert near < 0.05 * len(alike)
    made, written = {}, simhash.written

    def kept(df, label):
        evaluated = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        made.setdefault(label, []).append((evaluated, (out := written(df, label)).count()))
        return out

    monkeypatch.setattr(simhash, "written", kept)
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[a] == found[b] for (a, b), j in alike.items() if j >= 0.8)
    assert made["prefixes"] == [(1, len(docs))]
    assert made["pairs"][-1][1] <= 0.1 * len(alike), (made["pairs"], near, len(alike))


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Near copies around the limit: however many pairs they have, few of them are written for each member."""
    draw = random.Random(47)
    base = [f"w{draw.randrange(10**9)}" for _ in range(150)]
    docs = []
    for d in range(600):
        words = list(base)
        for place in draw.sample(range(0, 150, 5), draw.choice((0, 1, 2, 3, 4))):
            words[place] = f"v{draw.randrange(10**9)}"
        docs.append((d, " ".join(words)))
    sets = {d: shingles(t) for d, t in docs}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 50 * len(docs)
    smallest = {d: d for d in sets}
    for a, b in alike:
        low = min(smallest[a], smallest[b])
        for d in [d for d, s in smallest.items() if s in (smallest[a], smallest[b])] if smallest[a] != smallest[b] else []:
            smallest[d] = low
    made, kept = [], simhash._compared

    def compared(pairs, *rest):
        made.append(pairs.count())
        return kept(pairs, *rest)

    written = simhash.written

    def counted(df, label):
        out = written(df, label)
        made.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "_compared", compared)
    monkeypatch.setattr(simhash, "written", counted)
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == smallest
    assert max(made) <= 8 * len(docs), made
