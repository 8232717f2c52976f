import itertools

import xxhash
from brute import groups, rows

from tablewright.llm import simhash


def plain_print(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(docs):
    prints = [(d, plain_print(t)) for d, t in docs]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= 2]
    lowest = groups([d for d, _ in prints], links)
    return sorted({(d, f"{p:016x}", lowest[d]) for d, p in prints})


def test_query_equals_brute_force(spark, tiny):
    found = sorted(map(tuple, simhash.op5_simhash(spark, tiny).collect()))
    assert found == plain(rows(tiny, "documents", "doc_id, text"))


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(5, base), (9, base + " tail"), (2, None), (3, ""), (4, " \n "), (7, "One two"), (7, "One two"), (8, "one  TWO"), (6, "x " * 50_000), (1, "É a b c")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, print string, component int")
    found = sorted((r["doc_id"], f"{r['print'] & (1 << 64) - 1:016x}", r["component"]) for r in simhash.fingerprint_classes(df).collect())
    assert sorted(set(found)) == plain(docs)
    assert len(found) == len(docs)
    assert simhash.fingerprint_classes(df.limit(0)).count() == 0


def test_links_within_two_bits(spark):
    import random

    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(150)]
    for p in list(prints):
        for _ in range(draw.randrange(4)):
            for _ in range(draw.randrange(1, 4)):
                p ^= 1 << draw.randrange(64)
            prints.append(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.linked_pairs(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    links = [(a, b) for a, b in itertools.combinations(set(signed), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups(signed, [(r.src, r.dst) for r in got]) == groups(signed, links)
    assert all(((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 2 for r in got)
