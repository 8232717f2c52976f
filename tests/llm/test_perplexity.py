import re
from collections import Counter

import numpy as np
from brute import rows
from pyspark.sql import functions as F

from tablewright.llm import perplexity


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def check(found, docs):
    assert len(found) == len(docs)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_query_equals_brute_force_and_keeps_good_texts(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = perplexity.op8_perplexity(spark, sf_dir).collect()
    check(found, dict(rows(sf_dir, "documents", "doc_id, text")))
    quality = dict(rows(sf_dir, "labels", "doc_id, quality"))
    kept = {q: np.mean([r.kept for r in found if quality.get(r.doc_id) == q and not r.base_failed]) for q in (0, 1)}
    print(kept)
    assert kept[1] > 0.98 and kept[0] < 0.5


def grams_of(text, order=4):
    padded = [0xFFFFFF] * (order - 1) + [ord(c) for c in text or ""]
    return [tuple(padded[i : i + order]) for i in range(len(padded) - order + 1)]


def plain_model(texts, order=4):
    """Modified Kneser-Ney by the book, for the grams of one language's texts: gram -> probability, and gram -> the same with
    one occurrence left out of the counts."""
    levels = [Counter(g for t in texts for g in grams_of(t, order))]
    while len(levels) < order:
        levels.append(Counter(g[1:] for g in levels[-1]))
    lower = without = None
    for level in reversed(levels):
        n = [max(1, sum(c == k for c in level.values())) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        cut = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))]
        total, spread = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            spread[g[:-1]] += cut[min(c, 3)]
        even = 1 / (len(level) + 1)
        p, r = {}, {}
        for g, c in level.items():
            q, s = (lower[g[1:]], without[g[1:]]) if lower else (even, even)
            all_, took = total[g[:-1]], spread[g[:-1]]
            p[g] = (c - cut[min(c, 3)] + took * q) / all_
            q = s if c == 1 else q
            took += cut[min(c - 1, 3)] - cut[min(c, 3)]
            r[g] = (c - 1 - cut[min(c - 1, 3)] + took * q) / (all_ - 1) if all_ > 1 else q
        lower, without = p, r
    return lower, without


def test_model_equals_kneser_ney_by_the_book(spark, tiny):
    docs = rows(tiny, "documents", "lang, text") + [(None, "naïve \U0001f600 日本"), (None, "ab"), ("", "ab"), ("fr", None), ("fr", "")]
    df = spark.createDataFrame(docs, "lang string, text string")
    counts = perplexity.count_ngrams(df).collect()
    model = perplexity.kneser_ney(perplexity.count_ngrams(df)).collect()
    assert len(model) == len(counts) == len({r.hash for r in model})
    as_points = lambda raw: tuple(int.from_bytes(raw[i : i + 3], "big") for i in range(0, 12, 3))
    for lang in {lang for lang, _ in docs}:
        texts = [t for own, t in docs if own == lang]
        assert {as_points(r.gram): r.n for r in counts if r.lang == lang} == Counter(g for t in texts for g in grams_of(t))
        want, without = plain_model(texts)
        got = {as_points(r.gram): (r.p, r.r) for r in model if r.lang == lang}
        assert got.keys() == want.keys() and all(abs(got[g][0] - want[g]) < 1e-9 and abs(got[g][1] - without[g]) < 1e-9 for g in want)


def test_perplexity_equals_brute_force_by_broadcast_and_by_join(spark, tiny, monkeypatch):
    docs = rows(tiny, "documents", "doc_id, lang, text") + [(-1, None, None), (-2, "en", ""), (-3, "fr", "z"), (-4, "es", " \n")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    models = {lang: plain_model([t for _, own, t in docs if own == lang])[1] for lang in {lang for _, lang, _ in docs}}
    want = {d: -np.sum(np.log(np.maximum(1e-12, [models[lang][g] for g in grams_of(t)]))) / plain(t)[0] if plain(t)[0] else 0 for d, lang, t in docs}
    first = perplexity.apply_rules(df).collect()
    monkeypatch.setattr(perplexity, "BROADCAST_NGRAMS", 0)
    second = perplexity.apply_rules(df.select("*", F.lit(1).alias("_row"))).collect()
    for found, exact in ((first, 1e-4), (second, 1e-8)):
        assert {r.doc_id for r in found} == set(want) and len(found) == len(docs)
        assert all(abs(r.log_perplexity - want[r.doc_id]) < exact for r in found)
    assert {r.doc_id: r.kept for r in first} == {r.doc_id: r.kept for r in second}


def test_random_letters_of_any_script_stand_out(spark):
    """Prose in Cyrillic is told from random letters of the same script."""
    draw = np.random.default_rng(4)
    syllables = ["по", "ка", "за", "ра", "сти", "ми", "лено", "дов", "ни", "тель"]
    prose = [" ".join("".join(draw.choice(syllables, 3)) for _ in range(120)) for _ in range(300)]
    letters = list("абвгдежзийклмнопрстуфхцчшщыэюя")
    noise = [" ".join("".join(draw.choice(letters, 7)) for _ in range(120)) for _ in range(6)]
    df = spark.createDataFrame([(i, "ru", t) for i, t in enumerate(prose + noise)], "doc_id long, lang string, text string")
    kept = {r.doc_id: r.kept for r in perplexity.apply_rules(df).collect()}
    assert sum(kept[i] for i in range(300)) > 290 and not any(kept[i] for i in range(300, 306))


def test_lines_of_regular_letters_differ(spark):
    lines = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048)) for flip in (0, 1)]
    df = spark.createDataFrame([(0, "en", "\n".join(lines)), (1, "en", "\n".join([*lines, lines[0]]))], "doc_id long, lang string, text string")
    assert {r.doc_id: r.n_dup_lines for r in perplexity.apply_rules(df).collect()} == {0: 0, 1: 1}


def test_odd_rows(spark):
    texts = [None, "", "\n", "a b\nc d\n\n \nc d\nc d\r\nc d", "word " * 50, "é# " * 9 + "$", "one two three four five six seven eight nine ten", "x" * 100_000 + " y" * 20, "a\x1cb\x85c d e"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", "k", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string, lower double")
    check(perplexity.apply_rules(df).collect(), dict(enumerate(texts)))
    assert perplexity.apply_rules(df.limit(0)).count() == 0
    assert len(perplexity.apply_rules(df.union(df)).collect()) == 2 * len(texts)
