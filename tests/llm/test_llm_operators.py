"""Every operator on small inputs: against plain versions, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import lines_of, repeated_lines

from riskloom.llm import bytetext, grams, jaccard, kneser_ney, language, linededup, pitman_yor, toxicity
from riskloom.llm.chat import chat_digest, format_chats, read_back
from riskloom.llm.fmindex import FmIndex, decontaminate
from riskloom.llm.bytetext import blocks
from riskloom.llm.grams import PairTable, encode, encode_tokens, gram_counts, marked, normal_bytes, token_counts, token_hashes, tokens_of, unplanes
from riskloom.llm.jaccard import runs_for, similarity_join
from riskloom.llm.linededup import remove_repeated_lines
from riskloom.llm.packing import Encoder, pack, shortest_pack_first
from riskloom.llm.query_language_models import quality_scores
from riskloom.llm.query_packing import RANKS
from riskloom.llm.syncmers import edited_fingerprints, fingerprints, likeness
from pyspark.sql import functions as F

rng = np.random.default_rng(4)
WORDS = ["".join(rng.choice(list("abcdeféñ"), rng.integers(2, 6))) for _ in range(300)]


def prose(n: int) -> str:
    return "".join(w + (".\n" if i % 17 == 16 else ". " if i % 9 == 8 else " ") for i, w in enumerate(rng.choice(WORDS, n)))


LONG = prose(9000)
ROWS = [
    (0, prose(150)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (None, prose(40)), (None, None), (6, prose(60) + LONG[:3000]),
    (7, "É ù x　y  z\r\n\n[INST] </s> <|end|> \\l"), (8, LONG[3:]), (9, prose(150)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with columns named like the results and like inner names."""
    return spark.createDataFrame(ROWS, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("score"), F.lit(2).alias("n_words"), F.lit(3).alias("removed"), F.lit("x").alias("key"), F.lit("y").alias("node"), F.lit(0).alias("sequence_id")
    )


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words_of(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))


def test_line_dedup(spark, docs, nothing):
    lines = [" ".join(rng.choice(list("abcdef"), rng.integers(1, 6))) + str(rng.choice([".", "", ""])) for _ in range(20)]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(80)]
    got = {r.doc_id: r for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    want = repeated_lines(rows, 8)
    assert any(want.values())
    for d, text in rows:
        assert [x[3] for x in lines_of(got[d].text)] == [x[3] for i, x in enumerate(lines_of(text)) if i not in want[d]]
    odd = remove_repeated_lines(docs).collect()
    assert len(odd) == len(ROWS) and odd[0].key == "x"
    assert {r.text for r in odd if r.doc_id == 5} == {LONG}  # the first place of the passage
    assert all(r.n_removed > 0 for r in odd if r.doc_id in (6, 8)) and {r.text for r in odd if r.doc_id == 1} == {None}
    assert remove_repeated_lines(nothing).count() == 0


def test_line_dedup_moves_no_texts(spark):
    """Rows per fingerprint carry the keys alone: a text is not copied once for each of its lines."""
    taken = []

    class Rows:
        def __init__(self, rows):
            self.rows, self.schema, self.num_rows = rows, rows.schema, rows.num_rows

        def __getattr__(self, name):
            return getattr(self.rows, name)

        def select(self, names):
            return Rows(self.rows.select(names))

        def take(self, at):
            taken.append(list(self.schema.names))
            return self.rows.take(at)

    class Batch(Rows):
        def slice(self, *at):
            return Rows(self.rows.slice(*at))

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([LONG, LONG[3:]])], ["__id", "__key", "text"])
    assert sum(b.num_rows for b in linededup._placed(50)([Batch(batch)])) and taken
    assert all("text" not in names for names in taken)


def test_syncmers(docs, nothing):
    rows = sorted(({(d if d is not None else -1, t or "") for d, t in ROWS}))
    got = edited_fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    ids = sorted(((d if d is not None else -1, t or "") for d, t in ROWS), key=lambda x: x[0])
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in ids)
    by = {r.doc_id: r for r in got}
    a, b = ROWS[0][1], ""
    assert by[0].edited_sha256 == hashlib.sha256((a[: len(a) - len(a) // 4] + b).encode()).hexdigest()
    assert by[9].edited_sha256 and by[2].near_edited == 1.0 and by[0].near_edited > 0.5 > by[0].near_next
    prints = {}
    for r in fingerprints(docs).collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(prints[5]) == 1 and likeness(*prints[5], *prints[8]) > 0.9 and likeness(*prints[0], *prints[0]) == 1
    assert rows and edited_fingerprints(nothing).count() == 0


def test_jaccard(spark, docs, nothing):
    base = [prose(80).split() for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = str(rng.choice(WORDS))
        rows.append((i, " ".join(w)))
    sets = {d: {tuple(words_of(t)[i : i + 5]) for i in range(len(words_of(t)) - 4)} for d, t in rows}
    near = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    part = {d: d for d in sets}
    for _ in rows:
        part = {d: min([part[d], *(part[b] for a, b in near if a == d)]) for d in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near and got == {d: (part[d], sum(a == d for a, _ in near)) for d in sets}
    odd = similarity_join(docs).collect()
    assert len(odd) == len(ROWS) and {(r.class_id, r.n_links) for r in odd if r.doc_id in (5, 8)} == {(5, 2)}
    assert {(r.class_id, r.n_links) for r in odd if r.doc_id == 2} == {(2, 0)} and similarity_join(nothing).count() == 0
    assert runs_for(0.9999) >= 15


def test_loosely_like_classes_form_no_group(spark, monkeypatch):
    """Classes that agree in a third of the places are no candidates, however many share a leaf; a
    group of near copies among them is found whole, also when a leaf is dealt into blocks."""
    own = np.random.default_rng(8)
    draw = lambda n: own.integers(0, 1 << 16, (n, jaccard.COORDINATES)).astype(np.uint16)
    values = np.where(own.random((600, jaccard.COORDINATES)) < 0.6, draw(1), draw(600))
    copies = np.repeat(values[:1], 250, axis=0)
    np.put_along_axis(copies, own.integers(0, jaccard.COORDINATES, (250, 6)), draw(250)[:, :6], 1)
    values = np.concatenate((values, copies))
    nodes: list[list[int]] = [[] for _ in values]
    for one in jaccard.mix(np.arange(runs_for(0.9999), dtype=np.uint64)):
        for row, child in zip(*jaccard.children(np.full(len(values), one), values.astype(np.uint64), 0.8), strict=True):
            nodes[row].append(int(child.view(np.int64)))
    rows = [(i.to_bytes(4, "big"), v.tobytes(), n) for i, (v, n) in enumerate(zip(values, nodes, strict=True))]
    classes = spark.createDataFrame([(bytearray(k), bytearray(v), n) for k, v, n in rows], "key binary, signature binary, nodes array<long>")
    for dealt in (jaccard.DEALT, 100):
        monkeypatch.setattr(jaccard, "DEALT", dealt)
        found = jaccard.candidate_groups(classes, 0.8).collect()
        assert len({bytes(r.group) for r in found}) == 1 and {int.from_bytes(r.key, "big") for r in found} == {0, *range(600, 850)}


def test_leaders_keep_every_pair():
    """Rows that agree in enough places are linked, whatever leaders stand for them."""
    own = np.random.default_rng(9)
    base = own.integers(0, 1 << 16, (3, jaccard.COORDINATES))
    values = np.concatenate([np.where(own.random((150, jaccard.COORDINATES)) < p, b, own.integers(0, 1 << 16, (150, jaccard.COORDINATES))) for b, p in zip(base, (0.97, 0.85, 0.77), strict=True)])
    to, leaders, _ = jaccard.linked_to(values.astype(np.uint16))
    part = np.arange(len(to))
    for _ in to:
        part = np.minimum(part, part[to])
        np.minimum.at(part, to, part.copy())
    same = jaccard.agreement(values, values)
    assert (part[:, None] == part)[same >= 0.6 * jaccard.COORDINATES].all() and 3 < len(leaders) < 450 and len(set(part)) > 2


def test_fm_index():
    for _ in range(60):
        seq = [int(x) for x in rng.integers(1, 4, rng.integers(1, 50))]
        for at in sorted(rng.integers(1, len(seq) + 1, 3), reverse=True):
            if at == len(seq) or seq[at] and seq[at - 1]:
                seq.insert(at, 0)
        seq = np.array([x for i, x in enumerate(seq) if x or seq[i - 1]] + ([0] if seq[-1] else []))
        index = FmIndex(seq, 4, int(rng.integers(1, 9)))
        for _ in range(10):
            p = rng.integers(1, 4, rng.integers(1, 6))
            _, low, high = index.search(p[::-1][None, :], np.array([len(p)]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(low) else []
            assert found == [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]


def test_decontamination(spark, docs, nothing):
    items = [(1, LONG[500:700]), (2, "One"), (3, None), (4, ""), (10, " ".join(WORDS[:30])), (10, " ".join(WORDS[:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {i: [words_of(t)[k : k + 13] for k in range(max(1, len(words_of(t)) - 12))] for i, t in items if words_of(t)}
    for parts in (1 << 25, 1):
        for r in decontaminate(docs, bench, part_bytes=parts).collect():
            text = next(t for d, t in ROWS if d == r.doc_id and (d is not None or (t is None) == (r.text is None)))
            w = words_of(text)
            hit, seen = set(), set()
            for i, found in windows.items():
                for g in found:
                    for k in range(len(w) - len(g) + 1):
                        if w[k : k + len(g)] == g:
                            hit |= set(range(k, k + len(g)))
                            seen.add(str(i))
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (len(w), len(hit), sorted(seen), bool(hit) and 20 * len(hit) >= len(w))
            if hit:
                assert words_of(r.clean_text) == [x for k, x in enumerate(w) if k not in hit]
    assert decontaminate(nothing, bench).count() == 0 and decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_toxicity(spark, docs, nothing):
    rows = [(i, prose(60) + (" vile scum" if i % 4 == 0 else "") + prose(20), "en", int(i % 4 == 0)) for i in range(600)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(labelled.where("doc_id % 5 != 0"))
    got = {r.doc_id: r for r in toxicity.score(labelled, model).where("doc_id % 5 = 0").collect()}
    assert np.mean([r.predicted == r.toxic for r in got.values()]) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.fit(labelled.where("false")).net is None


def test_language(spark, docs, nothing):
    rows = [(i, prose(30).translate(str.maketrans("abcdef", "ghijkl")) if i % 2 else prose(30), ("aa", "bb", None)[2 if i % 9 == 0 else i % 2]) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, net = language.fit(labelled.where("doc_id % 5 != 0"))
    assert names == ["aa", "bb"]
    got = language.predict(labelled, names, net).where("doc_id % 5 = 0 and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = {r.doc_id: r for r in language.predict(docs, names, net).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[4].lang_pred != "und"
    assert language.predict(nothing, names, net).count() == 0 and language.fit(nothing)[1] is None


def test_text_scores(spark, docs, nothing):
    got = pitman_yor.text_log_probabilities(docs, F.coalesce(F.col("doc_id"), F.lit(1)) != 9).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [""] for _, t in ROWS]
    count = Counter(w for (d, _), ws in zip(ROWS, tokens, strict=True) if d != 9 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((len(ws), sum(count[w] > 0 for w in ws), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    # two kinds of text that share no words: contexts tell them apart, the base can't
    kinds = [[w + end for w in WORDS[:40]] for end in ("xa", "yo")]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 50))) for i in range(300)]
    held = pitman_yor.text_log_probabilities(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 != 2).where("not trained").collect()
    assert len(held) == 43 and all(r.base_score < r.score < 0 for r in held)
    assert pitman_yor.text_log_probabilities(nothing, F.lit(True)).count() == 0


def test_whole_words_are_contexts(spark):
    """Words with the same last bytes are contexts of their own, the end of a text is one too, and
    the dishes of a context, the unseen one among them, add up to one."""
    rows = [(i, " ".join(["mother", "tea", "father", "milk"] * 3)) for i in range(40)] + [(100, "mother tea"), (101, "mother milk"), (102, "tea"), (103, "mother")]
    got = {r.id: r for r in pitman_yor.text_log_probabilities(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 40).collect()}
    assert got["100"].score > got["101"].score + 1 and got["103"].score > got["102"].score + 1
    tokens = rng.integers(0, 30, 2000).astype(np.uint64)
    table = PairTable.of(np.append(tokens, np.uint64(0)), np.ones(2001, bool))
    parts = [table.part(mine, used) for _, mine, used in table.buckets(4)]
    again = PairTable.unpacked(*PairTable.merged(parts).packed())
    assert (again.pairs == table.pairs).all() and (again.counts == table.counts).all() and (again.hashes == table.hashes).all()
    rest = pitman_yor.Contexts(table)
    root = rng.dirichlet(np.ones(rest.size + 1))  # the last one for all unseen words
    for _ in range(3):
        rest.sweep(root[:-1], 0.7, rng)
        n, t = rest.total(rest.customers), rest.total(rest.tables)
        seen = np.bincount(rest.context, pitman_yor.chance(rest.customers, rest.tables, n[rest.context], t[rest.context], root[rest.word], 0.7), rest.size)
        other = np.ones(rest.size) - np.bincount(rest.context, root[rest.word], rest.size)
        assert np.allclose(seen + pitman_yor.chance(0, 0, n, t, other, 0.7), 1, atol=1e-12)
    totals = pitman_yor.Totals(9, 3, 0.7, 0.6, 9, 4)
    assert np.isclose(totals.root(np.array([5, 3, 1, 0]), np.array([2, 1, 1, 0])).sum(), 1)


def test_token_chunks_hold_no_texts(spark, docs):
    """The chunks of the model hold the tokens of the texts as numbers, and rows that are shuffled
    hold no hashes of words."""
    chunks = encode_tokens(docs.coalesce(1), F.lit(True), 5)
    assert "data" not in chunks.columns
    rows = chunks.collect()
    data, sizes = zip(*(normal_bytes(b) for b in blocks([pa.RecordBatch.from_arrays([pa.array([t for _, t in ROWS], pa.string())], ["text"])])), strict=True)
    want = {int(r): token_hashes(d, s) for r, (d, s) in enumerate(zip(data, sizes, strict=True))}
    got = []
    for row in rows:
        tokens, n = tokens_of(row.asDict())
        hashes = unplanes(row["hashes"], np.uint64)
        assert len(n) == len(row["ids"]) and n.sum() == len(tokens) and (unplanes(row["places"], np.int32) == (hashes % np.uint64(5)).astype(np.int64)).all()
        got += np.split(hashes[tokens], np.cumsum(n)[:-1])
    n = np.concatenate([token_counts(d, s) for d, s in zip(data, sizes, strict=True)])
    texts = np.split(np.concatenate([want[k] for k in sorted(want)]), np.cumsum(n)[:-1])
    assert sorted(x.tolist() for x in got) == sorted(x.tolist() for x in texts)
    merged = pitman_yor.merge_pairs(pitman_yor.chunk_pairs(chunks, 5), 3)
    for row in merged.where("chunk < 0").collect():
        table, shard = pitman_yor.table_of(row.asDict())
        bare, again = pitman_yor.table_of({k: v for k, v in row.asDict().items() if k != "hashes"})
        assert (shard == again).all() and (shard == pitman_yor.shard_of(table.hashes, 3)).all() and (bare.pairs == table.pairs).all() and not bare.hashes.any()


def test_seating():
    """Tables stay between one and the customers; more likely parents give more tables."""
    c = np.array([0, 1, 2, 50, 5000])
    low, high = (pitman_yor.seat(c, np.minimum(c, 1), np.full(5, 100), np.full(5, p), 0.8, np.random.default_rng(1)) for p in (1e-6, 0.5))
    assert (low <= high).all() and (high <= c).all() and low.tolist()[:2] == [0, 1] and high[4] > low[4] >= 1


def test_kneser_ney(docs, nothing, spark):
    """Probabilities add up to one after every context that was seen."""
    chunks = encode(docs, F.lit(True))
    values = {r.key: r.value for r in kneser_ney.log_probabilities(gram_counts(chunks)).collect()}
    assert all(v < 0 for v in values.values())
    pairs = np.zeros(1 << 16, np.int64)
    pairs[[256 * 97 + 98, 256 * 97 + 99, 256 * 99 + 98]] = [1, 2, 5]
    assert np.allclose(kneser_ney.short_table(pairs).reshape(256, 256).sum(1), 1)
    a = np.array([0, 3, 1, 2, 7])
    p = kneser_ney.interpolated(a, np.array([0, 0, 0, 1, 1]), np.array([0.2, 0.3, 0.5, 0.6, 0.4]), kneser_ney.discounts(9, 4, 3, 2))
    assert np.allclose([p[:3].sum(), p[3:].sum()], 1)
    rows = kneser_ney.perplexities(docs, F.col("doc_id") == 5, F.col("lang"))
    assert rows.count() == len(ROWS) and kneser_ney.perplexities(nothing, F.lit(True), F.col("lang")).count() == 0
    assert kneser_ney.judged(rows, docs.select(F.col("doc_id").cast("string").alias("id")).where("false")).where("rejected").count() == 0


def test_quality_learns_from_all_trusted_rows(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).unionAll(spark.createDataFrame([(None, 1), (5, 1), (99_999, 1)], "doc_id long, quality int"))
    got = quality_scores(docs, labels)
    assert got.count() == 21_000
    assert got.where("trained").count() == docs.where(F.pmod(F.xxhash64("text"), F.lit(5)) != 0).count()


def test_encoder_learns_words_in_parts(docs):
    """Words learned in several calls, in any mix, keep their own ids; nothing is sorted that isn't new."""
    coder = Encoder(RANKS, public_tokenizers.PATTERN)
    for words in ([b"one"], [b" two", b" ", b"a  b", "\u00e9t\u00e9".encode()], [b"three", b" four"], [b"\t"]):
        coder.learn(np.arange(len(coder.keys), len(coder.keys) + len(words), dtype=np.uint64), words)
    every = [b"one", b" two", b" ", b"a  b", "\u00e9t\u00e9".encode(), b"three", b" four", b"\t"]
    for k, w in enumerate(every):
        assert coder.flat[coder.at[k] : coder.at[k] + coder.n[k]].tolist() == coder.coder.encode_ordinary(w.decode())
    assert len(coder.flat) == coder.n.sum()  # as before: no breaks are kept


def test_span_hashes_keep_no_long_tables():
    """A worker that has hashed a long block holds no more than before; far spans hash like near ones."""
    values = rng.integers(0, 256, 3_000_000).astype(np.uint8)
    values[2_900_000:2_970_000] = values[70_100:140_100] = values[:70_000]
    starts = np.array([0, 70_100, 2_900_000, 5, 65_505, 3_000_000])
    got = bytetext.span_hashes(values, starts, starts + [70_000, 70_000, 70_000, 0, 0, 0])
    n = np.uint64(70_000)
    plain = sum((int(v) + 1) * pow(int(bytetext.BASE), i, 2**64) for i, v in enumerate(values[:70_000].tolist())) + int(n) * int(bytetext.BASE)
    assert (got[:3] == bytetext.mix(np.array([plain % 2**64], np.uint64))).all() and len(set(got[3:].tolist())) == 1
    kept = [x for v in vars(bytetext).values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in kept) < 4 << 20


def test_chunks_are_packed_as_they_come(docs):
    """What is held of a chunk's blocks is packed; the next chunk starts anew."""
    texts = [LONG, "", None, " A  b\n"] * 9
    part, whole = grams._byte_packer()
    for _ in range(2):
        held, plain = [], []
        for block in blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], limit=len(LONG) * 2):
            data, sizes = normal_bytes(block)
            kept, n = part(block)
            assert n == len(data)
            held.append(kept)
            plain.append((data, sizes))
        assert len(held) > 2 and sum(len(p) for p, _ in held) < sum(len(d) for d, _ in plain) / 2
        packed, sizes = whole(held)
        got = grams.text_of({"data": packed, "sizes": sizes})
        assert all(np.array_equal(a, np.concatenate(b)) for a, b in zip(got, zip(*plain, strict=True), strict=True))


def test_chunk_grams_in_parts(monkeypatch):
    """However often parts are merged, a chunk's n-grams and counts are those of all its texts."""
    part, whole = grams._byte_packer()
    texts = [prose(40) for _ in range(50)]
    block = next(blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]))
    data, sizes = whole([part(block)[0]])
    row = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([data]), pa.array([sizes]), pa.array([[i % 3 > 0 for i in range(50)]])], ["chunk", "data", "sizes", "trained"])
    one = next(grams._chunk_grams([row]))
    cut = grams.text_groups
    monkeypatch.setattr(grams, "MERGED_AT", 10)
    monkeypatch.setattr(grams, "text_groups", lambda sizes, step: cut(sizes, 500))
    assert next(grams._chunk_grams([row])).equals(one) and one.num_rows == 1


def test_trusted_ids_move_no_texts(spark):
    """Ids come to the chunks as bits, whatever their number: no plan with a text joins before the chunks."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (2, "d")], "doc_id long, text string")
    chunks = encode(docs, F.lit(True))
    got = marked(chunks, spark.createDataFrame([("2",), ("7",)], "id string")).select(F.explode(F.arrays_zip("ids", "trained")).alias("r")).select("r.*").collect()
    assert Counter((r.ids, r.trained) for r in got) == Counter({("2", True): 2, ("1", False): 1, (None, False): 1})
    assert "text" not in marked(chunks, spark.createDataFrame([("2",)], "id string")).columns


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    got = pack(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = Counter()
    for d, t in ROWS:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, a, ids[a : a + 1024].tobytes(), len(ids)) for a in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    at: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024 and sorted(at) == list(range(len(at)))
    assert pack(nothing, RANKS, public_tokenizers.PATTERN).count() == 0 and Encoder(RANKS, public_tokenizers.PATTERN).break_id == 198
    patterns = shortest_pack_first({10: 3, 6: 5, 4: 7, 1: 9}, 10)
    placed = Counter()
    for p, n in patterns:
        assert sum(p) <= 10
        placed.update({x: p.count(x) * n for x in set(p)})
    assert placed == {10: 3, 6: 5, 4: 7, 1: 9}


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "a <|end|> \\l [/INST]"), (1, 0, "user", None), (2, 0, "assistant", "x"), (3, 0, None, ""), (3, 0, None, ""),
        (4, 2, "user", "<|user|>"), (4, 0, "system", "s"), (4, 1, "user", "\\\\b|>"), (None, 0, "user", "é"), (None, None, "assistant", "ü"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(2))
    chats = format_chats(turns)
    got = {r.conv_id: r for r in chat_digest(chats).collect()}
    back = {r.conv_id: r for r in read_back(chats).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(x.role, x.text) for x in back[conv].read_turns] == [x[1:] for x in mine]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert back[conv].learned == "".join(t for _, role, t in mine if role == "assistant") and got[conv].loss_chars == len(back[conv].learned)
    assert {c: got[c].well_formed for c in (1, 2, 3, 4)} == {1: True, 2: False, 3: False, 4: False}
    assert format_chats(turns.where("false")).count() == 0
