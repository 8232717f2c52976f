import random

import numpy as np
import pyarrow as pa
from brute import groups

from tablewright.llm import common


def test_components_equal_brute_force(spark):
    draw = random.Random(11)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1070)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (7, None)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = {n for e in real for n in e}
    assert found == groups(nodes, real)
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chunks_hold_every_text_whole():
    texts = ["a", None, "", "b" * 50, "é", "c" * 7]
    for kind in (pa.string(), pa.large_string()):
        column = pa.chunked_array([pa.array(texts[:2], kind), pa.array(texts[2:], kind)])
        got, rows = [], []
        for first, data, offsets in common.text_chunks(column, 10):
            rows.append(first)
            raw = data.tobytes()
            got += [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
        assert got == [t or "" for t in texts] and rows == sorted(set(rows))
    assert list(common.text_chunks(pa.array([], pa.string()))) == []


def test_words_and_hashes():
    text = ["a\x1cb c\x0bd", "", "ab ab", " x "]
    ((_, data, offsets),) = common.text_chunks(pa.array(text), 1000)
    starts, ends, rows = common.word_spans(data, offsets)
    raw = data.tobytes()
    assert [(int(r), raw[a:b]) for r, a, b in zip(rows, starts, ends)] == [(0, b"a\x1cb"), (0, b"c"), (0, b"d"), (2, b"ab"), (2, b"ab"), (3, b"x")]
    hashes = common.span_hashes(data, starts, ends)
    assert hashes[3] == hashes[4] and len(set(hashes.tolist())) == 5
    long = np.frombuffer(b"q" * (5 << 20), dtype=np.uint8)
    assert len(set(common.span_hashes(long, np.array([0, 9]), np.array([5 << 20, (5 << 20)])).tolist())) == 2


def test_long_regular_words_differ():
    """The Thue-Morse word and its complement collide under every polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (512, 1024, 2048, 4096):
        both = [bytes(b"ab"[b ^ flip] for b in bits[:size]) for flip in (0, 1)]
        data = np.frombuffer(b" ".join([*both, both[0]]), dtype=np.uint8)
        starts = np.array([0, size + 1, 2 * size + 2])
        a, b, again = common.span_hashes(data, starts, starts + size).tolist()
        assert a != b and a == again


def jobs_of(spark, run):
    context, group = spark.sparkContext, f"jobs-{random.random()}"
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_a_write_tells_its_measures(spark):
    df = spark.range(1000).filter("id % 3 = 0")
    out, found = common.measured(df, "measured", n=common.F.count("*"), most=common.F.max("id"))
    assert found == {"n": 334, "most": 999} and out.count() == 334 and out.columns == ["id"]
    out, found = common.measured(df.filter("id < 0"), "measured", n=common.F.count("*"), most=common.F.max("id"))
    assert found == {"n": 0, "most": None} and out.count() == 0


def test_components_ask_for_nothing_beside_their_writes(spark, monkeypatch):
    """Each query leaves plans, broadcasts and threads on the driver: rounds are told by their writes, and no edges need none."""
    labels = []
    monkeypatch.setattr(common, "written", lambda df, label, f=common.written: labels.append(label) or f(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    monkeypatch.setattr(type(edges), "first", None)
    assert {r.component for r in common.components(edges).collect()} == {0}
    assert len(labels) > 2
    labels.clear()
    assert jobs_of(spark, lambda: common.components(edges.filter("src < 0"))) <= 2
    assert labels == ["edges"]
