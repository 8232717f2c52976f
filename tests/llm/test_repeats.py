import hashlib
import random

import pyarrow.compute  # noqa: F401
import pytest
from brute import rows

from tablewright.llm import repeats


def plain(docs, length=50):
    """docs: (key, text); a null key counts as the largest."""
    order = float("inf")
    least = {}
    for key, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(least.get(s, order), order if key is None else key)
    out = []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < (order if key is None else key):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert got(repeats.op1_repeats(spark, sf_dir)) == plain(rows(sf_dir, "documents", "doc_id, text"))


@pytest.mark.parametrize("common", [256, 1])
def test_passages_and_odd_rows(spark, monkeypatch, common):
    monkeypatch.setattr(repeats, "COMMON_BLOCKS", common)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abé\0 ", k=draw.randrange(1, 9)))
    line = "".join(word() for _ in range(14))
    texts = [None, "", "x" * 49, "x" * 50, "y" * 51, "x" * 3000, "ab" * 700, "ba" * 40, line, line]
    for _ in range(40):
        text = "".join(word() for _ in range(draw.randrange(40)))
        cut = draw.randrange(0, 40)
        texts.append(text + line[cut : cut + draw.randrange(20, 90)] + (draw.choice([t for t in texts if t])[-70:]) + word())
    docs = [(None if i % 17 == 16 else i // 2 if i % 5 else i, t) for i, t in enumerate(texts)]
    draw.shuffle(docs)
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, kept string, n_spans int")
    assert got(repeats.remove_repeats(df)) == plain(docs)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_real_outputs_agree_with_the_digest(spark):
    df = spark.createDataFrame([(1, "a" + "same words again and again, fifty bytes of them at least." + "b"), (2, "c" + "same words again and again, fifty bytes of them at least." + "d")], "doc_id long, text string")
    second = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}[2]
    assert bytes(second.kept) == b"cd" and [tuple(s) for s in second.removed] == [(1, 58)]


def test_pieces_move_once_and_in_parts_where_much_repeats(spark, monkeypatch):
    draw, plans, write = random.Random(9), [], repeats.written

    def watched(df, label, *rest):
        if label == "answers":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *rest)

    monkeypatch.setattr(repeats, "written", watched)
    lines = ["".join(draw.choices("abcdefgh é", k=90)) for _ in range(30)]
    docs = [(i, "".join(draw.sample(lines, 25))) for i in range(24)]
    docs += [(None, docs[3][1] + "x"), (5, docs[5][1]), (24, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(repeats.remove_repeats(df)) == plain(docs)
    assert len(plans) > 1  # nearly all text repeats: its pieces and their places are more than the text
    assert all(sum("Exchange" in line for line in plan.splitlines()) == 1 for plan in plans)


def test_blocks_send_few_bytes_for_an_anchor():
    draw = random.Random(10)
    texts = ["".join(draw.choices("abcdefgh", k=50_000)) for _ in range(8)] * 2
    docs = repeats.pa.table({"doc": list(range(16)), "tag": list(range(16)), "text": texts, "block": [0] * 16})
    none = repeats.pa.table({"doc": repeats.pa.array([], "int64"), "tag": repeats.pa.array([], "int64")})
    sent = repeats._anchors_of_block(4)(docs, none)
    different = set()
    for _, data, offsets in repeats.text_chunks(docs.column("text")):
        different |= set(repeats.anchors(data, offsets)[2].tolist())
    size = sum(repeats.pa.compute.binary_length(sent.column(c)).to_numpy().sum() for c in sent.column_names if c not in ("bucket", "block"))
    assert len(different) > 20_000 and size < 4.2 * len(different)
    values = [v for b in sent.column("hashes").to_pylist() for v in repeats._unpacked(b).tolist()]
    assert len(values) == len(different) and repeats._packed(repeats._unpacked(b"\0\1\2\3\4\5\6\7")) == b"\0\1\2\3\4\5\6\7"
    back = repeats._repeated_anchors(sent.filter(repeats.pa.compute.equal(sent.column("bucket"), 2)))
    assert back.column("hashes").to_pylist() == sent.column("hashes").to_pylist()[2:3] and not any(back.column("common")[0].as_py())
