"""Term weights against a plain count, and how many rows they keep."""

import math
import random
from collections import Counter

import pytest

from riskloom.operators import documents as N


def plain(rows, terms, least):
    tf = Counter()
    for key, text in rows:
        words = (text or "").split()
        tf.update((key, g) for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    total, docs = Counter(), Counter()
    for (_, g), n in tf.items():
        total[g] += n
        docs[g] += 1
    chosen = sorted((g for g in docs if docs[g] >= least), key=lambda g: (-total[g], g))[:terms]
    w = {(k, g): n * (math.log((1 + len(rows)) / (1 + docs[g])) + 1) for (k, g), n in tf.items() if g in chosen}
    norm = Counter()
    for (k, _), x in w.items():
        norm[k] += x * x
    return {kg: x / math.sqrt(norm[kg[0]]) for kg, x in w.items()}


def test_tfidf(spark, monkeypatch):
    rnd = random.Random(3)
    words = [a + b for a in "abcdefgh" for b in "stuvwxyz"]
    rows = [(i // 2 if i < 10 else i, " ".join(rnd.choices(words, k=40))) for i in range(60)]
    rows += [(None, "as bs as bs cs"), (None, "as bs"), (99, None), (98, "")]
    # many times in two rows of one key: in fewer keys than asked for
    rows += [(70, " ".join(f"only{i}" for i in range(30)) * 1)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for terms, least in ((5, 2), (40, 2), (40, 4), (100_000, 2), (7, 1)):
        got = {(r.doc_id, r.term): r.weight for r in N.tfidf(df, "doc_id", "text", terms=terms, least_docs=least, stop=()).collect()}
        want = plain(rows, terms, least)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    kept = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda d: kept.append(d.count()) or cut(d))
    N.tfidf(df, "doc_id", "text", terms=5, stop=()).count()
    assert max(kept) <= 5 * len(rows)  # not every term of every document
