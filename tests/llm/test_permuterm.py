"""Operator 11 against a plain version: every word, form, root and count."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import permuterm
from riskloom.llm.permuterm import rotation_keys, spelling_variants


def plain(rows, min_chars=6, min_count=5, ratio=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    out = {}
    for w, n in words.items():
        ns = sorted((-words[v], v) for v in words if near(w, v))
        form = ns[0][1] if ns and -ns[0][0] >= ratio * n else None
        out[w] = [form, n, len(ns), words[form] if form else None]
    for w, row in out.items():
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w] = (row[0], r, row[1], row[2], row[3])
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = spelling_variants(df, **kw).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


BASE = ["colour", "colours", "colourful", "résumé", "resume", "ÉCOLES", "écoles", "écolés", "abcdef", "abcdefg", "xbcdef"]


def corpus():
    rows, i = [], 0
    weights = {"colour": 30, "colours": 6, "colourful": 5, "colouur": 5, "coluur": 5, "résumé": 25, "resume": 5, "ÉCOLES": 5, "écoles": 5, "écolés": 30, "abcdef": 40, "abcdefg": 8, "xbcdef": 5, "aabcdef": 5, "aaaaaaa": 9, "aaaaaa": 50}
    for w, n in weights.items():
        for _ in range(n):
            rows.append((i, f"{w}, {w.upper()}!\n{w}"))
            i += 1
    rows += [(None, "colour " * 5), (None, None), (i, ""), (i + 1, "x" * 50000 + " colour"), (i + 1, "x" * 50000 + " colour")]
    return rows


def test_against_plain(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_chains_and_ties(spark):
    rows = [(i, "abcdefgh") for i in range(200)] + [(1000 + i, "abcdefgx") for i in range(32)] + [(2000 + i, "abcdefxx") for i in range(5)] + [(3000 + i, "zbcdefgh") for i in range(200)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert got["abcdefxx"][1] in ("abcdefgh",) and got["abcdefgx"][0] == "abcdefgh"


def test_rotations_are_linear_and_match():
    keys = {k for k in rotation_keys("abcd") if k[0] == "cut"}
    assert {k for k in rotation_keys("abxd") if k[0] == "cut"} & keys
    assert {k[2] for k in rotation_keys("abd") if k[0] == "full"} & {k[2] for k in keys}
    assert sum(1 for _ in rotation_keys("a" * 100000)) == 200001


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (None, "")]) == {}


def test_words_are_never_broadcast(spark, monkeypatch):
    """Files of words are far smaller than the words in memory, so Spark's estimate does not decide."""
    plans, write = [], permuterm.cut_lineage

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(permuterm, "cut_lineage", written)
    rows = corpus()
    out = spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(out.collect()) == len(plain(rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
