"""Phrase mining, clustering and toxicity against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import clustering, collocation, toxicity

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _brute(rows, least, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    own = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, g), a in own.items():
        if any(a2 >= a and len(h) > len(g) and any(h[j : j + len(g)] == g for j in range(len(h))) for (l2, h), a2 in own.items() if l2 == lang):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i, g.decode(), -a, l, r, n[lang], -s) for lang, got in out.items() for i, (s, a, g, l, r) in enumerate(sorted(got)[:most], 1))


def _texts():
    rng = random.Random(3)
    w = "of the THE and a b c dd é naïve x1 the of".split()
    rows = [(" ".join(rng.choice(w) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("one common passage that returns, a a a a a a a", "en")] * 30
    return rows + [(None, "en"), ("", None), (" ,.\n", "de"), ("a b " * 3000, "en"), ("\x0b.\x0cx", "en")]


@pytest.mark.parametrize(("vocabulary", "size"), [(1 << 20, 500_000), (4, 50), (1 << 20, 200)])
def test_collocations(spark, monkeypatch, vocabulary, size):
    monkeypatch.setattr(collocation, "VOCABULARY", vocabulary)
    monkeypatch.setattr(collocation, "SIZE", size)
    monkeypatch.setattr(collocation, "TOP_ROWS", 100)
    rows = _texts()
    d = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, part string")
    got = collocation.collocations(d, least=5, most=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _brute(rows, 5, 60)


def test_collocations_of_words_that_are_names_of_languages(spark):
    texts = {"de": "es war de und es ist en", "es": "de la es de lo en", "en": "de en es en la", None: "und de und es war", "und": "es und en"}
    rows = [(text, lang) for i, (lang, text) in enumerate(texts.items()) for _ in range(6 + i)]
    got = collocation.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5, most=60)
    assert sorted(map(tuple, got.collect())) == _brute(rows, 5, 60)


def test_collocations_of_nothing(spark):
    d = spark.createDataFrame([], "text string, lang string")
    assert collocation.collocations(d).count() == 0
    assert collocation.collocations(spark.createDataFrame([("a b", None)], "text string, lang string")).count() == 0


def _clusters(rows, k, rounds):
    v = [(i, tuple(int(1024 * x // 1) for x in e)) for i, e in rows if e is not None and len(e) == 3 and all(x is not None and abs(x) < 1e300 for x in e)]
    first = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [x for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(v, own) if o == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine))
    last = [near(x) for _, x in v]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(v, last)), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(300, 8, 10), (60, 5, 3), (3, 8, 10), (0, 8, 10)])
def test_clusters(spark, n, k, rounds):
    rng = random.Random(n)
    rows = [(i, [round(rng.gauss(0, 0.01), 3) for _ in range(3)]) for i in range(n)]
    if n > 3:
        rows += [(5, rows[5][1]), (5, [0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3]), (901, None), (902, [0.1, 0.2]), (903, [0.1, None, 0.3]), (904, [0.1, float("nan"), 0.2]), (905, [0.1, float("-inf"), 0.2]), (906, [])]
    d = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    got = clustering.cluster(d, k=k, rounds=rounds, dim=3)
    assert sorted(map(tuple, got.collect()), key=str) == _clusters(rows, k, rounds)


def test_components_that_do_not_fit(spark):
    d = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(d, dim=2).count()


def _toxic_rows():
    rng = random.Random(5)
    plain = ["the", "of", "stone", "water", "tree", "walk", "light", "house", "idea", "Ünter"]
    bad = ["vile", "Vilest", "grubby", "grub"]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 7 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(w), toxic))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out(spark):
    docs, labels = _toxic_rows()
    odd = [(None, "vile grub vile grubby", False), (None, None, False), (9001, "", False), (9002, None, False), (2, docs[2][1], False)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in docs + odd], "doc_id long, text string, toxic int, held_out string").repartition(3)
    y = spark.createDataFrame(labels + [(None, 1, 1), (4, 1, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, y).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: t for i, _, t in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(bool(r.predicted) == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] in ([1, 0], [0, 1])
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1
    # other labels of held-out rows change nothing
    y2 = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels] + [(10**9, 1, 1)], "doc_id long, quality int, toxic int")
    again = {(r.doc_id, r.predicted) for r in toxicity.score(d, y2).collect() if r.doc_id is not None}
    assert again == {(r.doc_id, r.predicted) for r in got if r.doc_id is not None}


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score(d, y).collect()] == [0, 0]
    assert toxicity.score(d.limit(0), y.union(spark.createDataFrame([(1, 1, 1)], y.schema))).count() == 0


def test_risk_step_turns_where_the_clean_risk_is_negative():
    import numpy as np

    # one weight and the intercept; rows: all as clean, toxic as clean, toxic as toxic; then count and loss
    sums = np.array([[10.0, 50.0, 100.0, 40.0], [8.0, 9.0, 10.0, 30.0], [-2.0, -1.0, 10.0, 5.0]])
    assert np.allclose(toxicity.step(sums, 0.1), [0.1 * -0.2 + 0.1 - 0.08, 0.1 * -0.1 + 0.5 - 0.09])
    sums[0, 3] = 20.0
    assert np.allclose(toxicity.step(sums, 0.1), [-(0.1 - 0.08), -(0.5 - 0.09)])
