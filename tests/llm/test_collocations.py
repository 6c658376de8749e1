"""Collocations against counting everything."""

import random
import re
from collections import Counter

import pytest


def brute(docs, least, top):
    f = Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang or "und", tuple(w[i : i + n])] += 1
    cand = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cand[lang, p] = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
    gone = {(lang, p[i : i + m]) for lang, p in cand for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * f[lang, p] >= 80 * f[lang, p[i : i + m]]}
    out = []
    for lang in {x for x, _ in cand}:
        n = sum(a for (x, p), a in f.items() if x == lang and len(p) == 1)
        rows = sorted((-c[0], -f[lang, p], " ".join(p).encode(), c) for (x, p), c in cand.items() if x == lang and (x, p) not in gone)
        out += [(lang, k, p.decode(), -a, c[2], c[3], n, c[0]) for k, (_, a, p, c) in enumerate(rows[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    stock = [" ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(2, 6))) for _ in range(25)]
    for i in range(n):
        parts = [r.choice(stock) if r.random() < 0.5 else " ".join(f"W{min(int(r.paretovariate(0.7)), 60)}" for _ in range(r.randint(1, 9))) for _ in range(30)]
        yield r.choice(["en", "en", "en", "de", None]), "".join(p + r.choice([" ", "  ", ". ", "\t", "\n", "é "]) for p in parts)


@pytest.mark.parametrize("least,top,widen", [(5, 40, 1), (12, 10, 1), (5, 2000, 4)])
def test_collocations(spark, least, top, widen):
    from tessella.llm.collocations import collocations

    docs = [*texts(least, 120), ("und", "w1 w2 w3 w1 w2"), ("en", ""), ("en", None), (None, "a\x0bb c" * 9), ("de", "long " * 40_000)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "lang string, text string, f int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in collocations(df, least=least, top=top, widen=widen).collect())
    assert got == brute(docs, least, top)
    assert collocations(df.where("false")).count() == 0


def test_shared_bits_do_not_change_results(spark, monkeypatch):
    """With 8 bits every phrase shares its bit with others; the counts stay."""
    from tessella.llm import collocations as m

    docs = list(texts(1, 60))
    df = spark.createDataFrame(docs, "lang string, text string")
    pieces = df.selectExpr("coalesce(lang, 'und') lang", "text")
    plain = {tuple(r) for r in m.counts(pieces, 1, 5).collect()}
    field = m.bit_field(m.counts(pieces, 1, 5), 1)
    assert m.holds(field, np_hashes(m, plain)).all()
    got = {tuple(r) for r in m.counts(pieces, 2, 5, {"words": field}).collect()}
    full = {tuple(r) for r in m.counts(pieces, 2, 5, {"words": field * 0 + 255}).collect()}
    assert got == full and got


def np_hashes(m, rows):
    import numpy as np

    from tessella.llm.words import mix, word_hashes

    out = []
    for lang, phrase, _ in rows:
        b = phrase.encode()
        out.append(mix(word_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]), False)[0] ^ m.lang_hash(lang))[0])
    return np.array(out, np.uint64)


def test_scores_beyond_64_bits(spark):
    from tessella.llm.collocations import scored

    big = 8 * 10**15
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    row = scored(pairs, 2, {1: words}).first()
    assert row.score == 2000000 * big // (2 * big + 3) and row.bound == 2000000 * big // (2 * big + 1)
