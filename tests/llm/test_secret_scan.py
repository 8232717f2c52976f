import hashlib
import random
import re

from brute import rows

from tablewright.llm import secret_scan


def plain(text):
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, hashlib.sha256(",".join(s for *_, s in sorted(found)).encode()).hexdigest()), {s for *_, s in found}


def check(found, docs):
    assert len(found) == len(docs)
    for r in found:
        base, spans = plain(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == base
        listed = r.spans.split(",") if r.spans else []
        assert spans == {s for s in listed if not s.startswith("novel")}
        assert [int(s.split(":")[1]) for s in listed] == sorted(int(s.split(":")[1]) for s in listed)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = secret_scan.op7_secrets(spark, sf_dir).collect()
    check(found, dict(rows(sf_dir, "documents", "doc_id, text")))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found) > 20


def test_odd_rows(spark):
    draw = random.Random(4)
    key = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    texts = [
        None, "", "é" * 50 + " PassWord = 'abcdefgh' tail", "ſecret=abcdefghij", "token: short", "AKIA" + "B" * 12, "AKIAB", "0123456789abcdef" * 2,
        "token=" + "0123456789abcdef" * 3, "x " * 100_000 + "apikey:" + "z" * 9, f"Authorization: Bearer {key}", f"Authorization: Bearer {key}", f"nothing to hide {key}",
        "access key " + "example_" * 6 + "1", "deadbeef" * 3, "secret=a secret=abcdefgh", "\n".join(["a" * 31 + "g", "f" * 32]),
    ]
    df = spark.createDataFrame([(i, t, "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars int")
    found = secret_scan.find_secrets(df).collect()
    check(found, dict(enumerate(texts)))
    novel = {r.doc_id for r in found if "novel" in r.spans}
    assert novel == {10, 11}
    hidden = {r.doc_id: r for r in secret_scan.mask_secrets(df).collect()}
    assert hidden[10].text == "Authorization: Bearer [SECRET]" and hidden[10].n_chars == 30
    assert hidden[0].text is None and hidden[12].text == texts[12]
    assert hidden[2].text == "é" * 50 + " [SECRET]' tail"
    assert secret_scan.find_secrets(df.limit(0)).count() == 0 == secret_scan.mask_secrets(df.limit(0)).count()


def test_many_assignments_in_one_text():
    """100,000 base spans and as many candidates: time in proportion, the same spans as for a part."""
    import time

    part = "password = Zx9kQ7vB2mL4nR8tYw3p session Qm8xV2kL9zT4wR7nB3cD; "
    scan = secret_scan.NoveltyScan()
    scan.novelty = lambda text, a, b: 1.0
    few = scan.spans(part * 20)
    began = time.monotonic()
    many = scan.spans(part * 100_000)
    assert time.monotonic() - began < 60
    assert len(many) == 5000 * len(few) and many[: len(few) - 2] == few[:-2]
