"""Spelling variants grouped through permuterm rotations (operator 11).

Every word w is taken with a terminator, s = w + "$", and all its rotations are keyed. Two words
that differ by one replaced code point share the rotation that starts right after the edited place
once its last code point (the edited one) is cut off; a word w' that is w with one code point
deleted has, as a whole rotation, the rotation of w that starts after the deleted place with that
code point cut off. So the sorted rotations turn every one-edit neighbourhood into one key: a
shuffle by key (Spark's sort of all rotations) and a scan of each key group emit exactly the
neighbours, with no candidate pairs. A key group holds at most one whole rotation and one cut
rotation per code point of the alphabet, whatever the corpus size.

Keys are 61-bit polynomial hashes of the rotations, computed in O(length) a word from prefix
hashes, so a very long word costs its length, not its square. Every emitted pair is checked
exactly (Levenshtein distance 1 with a bound, so also linear), which makes a hash collision harmless.

Joins of words ask for sort-merge: the files of a word table are far smaller than its rows in
memory, and by the files' size Spark would collect hundreds of thousands of words on the driver for
a broadcast.

`spelling_variants(docs)` takes the runs `[A-Za-z\\u00C0-\\u00FF]+` of the texts, lower-cases
A-Z only, and with h the unsigned CRC-32 of "<doc_id>:<run>" deletes the code point h % length of
the runs where 199 divides h (a planted typo). Words are the distinct results with at least
`min_chars` code points and at least `min_count` occurrences. A word's form is its near word of
largest count (ties: smallest in code-point order) if that count is at least `ratio` times its own,
else null; its root follows forms to the last word (forms raise the count by `ratio` each step,
so chains are short and acyclic).

Special cases: a null text has no runs; a null doc_id is written as the empty string in the hash
input; an empty table gives no rows; repeated rows count again; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_c = F.col
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOD, BASE, END = (1 << 61) - 1, 1_000_003, 0x110000
NO_BROADCAST = "merge"


def rotation_keys(word: str) -> Iterator[tuple[str, int, int]]:
    """(kind, length, hash) of every rotation of word + '$' ("full") and of every rotation with
    its last code point, a letter, cut off ("cut")."""
    s = [ord(ch) for ch in word] + [END]
    m = len(s)
    pre, pw = [0] * (m + 1), [1] * (m + 1)
    for i, c in enumerate(s):
        pre[i + 1] = (pre[i] * BASE + c) % MOD
        pw[i + 1] = pw[i] * BASE % MOD

    def part(a: int, b: int) -> int:
        return (pre[b] - pre[a] * pw[b - a]) % MOD

    for i in range(m):
        yield "full", m, (part(i, m) * pw[i] + pre[i]) % MOD
        if i:
            yield "cut", m - 1, (part(i, m) * pw[i - 1] + pre[i - 1]) % MOD


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(w, k, n, h - (1 << 60)) for w in f["word"] for k, n, h in rotation_keys(w)]
        yield pd.DataFrame(rows, columns=["word", "kind", "klen", "key"]).astype({"klen": "int64", "key": "int64"})


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): words after the planted deletions, counted over all rows (map-side partial
    counts, so a very frequent word is one row a partition before the shuffle)."""
    text = F.coalesce(_c("text").cast("string"), F.lit(""))
    runs = docs.select(F.coalesce(_c("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    low = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "id")
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    cut = h % F.char_length("run")
    edited = F.when(h % 199 == 0, F.concat(F.substring("run", 1, cut.cast("int")), F.substring("run", (cut + 2).cast("int"), 1 << 30))).otherwise(_c("run"))
    words = low.select(edited.alias("word"))
    counted = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(_c("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b for every two words at edit distance one, each pair once."""
    keys = words.select("word").mapInPandas(_keys, "word string, kind string, klen long, key long").distinct()
    cut, full = keys.where("kind = 'cut'"), keys.where("kind = 'full'")
    same = cut.alias("x").join(cut.alias("y").hint(NO_BROADCAST), ["klen", "key"]).where(_c("x.word") < _c("y.word")).select(_c("x.word").alias("a"), _c("y.word").alias("b"))
    shorter = cut.alias("x").join(full.alias("y").hint(NO_BROADCAST), ["klen", "key"]).select(_c("x.word").alias("u"), _c("y.word").alias("v"))
    shorter = shorter.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    pairs = same.unionByName(shorter).distinct()
    return pairs.where((_c("a") != _c("b")) & (F.levenshtein("a", "b", 1) == 1))


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    words = cut_lineage(word_counts(docs, min_chars, min_count))
    pairs = near_pairs(words)
    both = pairs.select(_c("a").alias("word"), _c("b").alias("near")).unionByName(pairs.select(_c("b").alias("word"), _c("a").alias("near")))
    counts = words.select(_c("word").alias("near"), _c("n").alias("near_n"))
    best = both.join(counts.hint(NO_BROADCAST), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-_c("near_n"), _c("near"))).alias("top")
    )
    table = words.join(best.hint(NO_BROADCAST), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(_c("top.near_n") >= ratio * _c("n"), _c("top.near")).alias("form"),
        F.when(_c("top.near_n") >= ratio * _c("n"), _c("top.near_n")).alias("form_n"),
    )
    table = cut_lineage(table)
    return table.join(roots(table.select("word", "form")).hint(NO_BROADCAST), "word").select("word", "form", "root", _c("n").cast("long"), "n_near", _c("form_n").cast("long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: each round a word jumps to the pointer of its pointer,
    until no pointer moves; the number of rounds is the logarithm of the longest chain."""
    ptr = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        hop = ptr.alias("p").join(ptr.alias("q").hint(NO_BROADCAST), _c("p.root") == _c("q.word")).select(_c("p.word"), _c("q.root").alias("root"), (_c("q.root") != _c("p.root")).alias("moved"))
        hop = cut_lineage(hop)
        if not hop.where("moved").limit(1).count():
            return hop.select("word", "root")
        ptr = hop.select("word", "root")
