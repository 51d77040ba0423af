"""Each operator against a plain version, and with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, html, langid, licenses, linededup, minhash, toxicity, vectors
from strandloom.llm.common import word_hashes
from strandloom.plans.components import connected_components
from strandloom.plans.tables import written

DOC = "doc_id long, text string, score string, component_id string, fp int, node string, hits string, cut string, lang string"
ODD = [None, "", " \n\t", "a", "word " * 30_000, "é ü ß", "\x00\x1f", "x" * 200_000]


def words(n, rng, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def docs(spark, texts, first=0):
    rows = [(first + i, t, "s", "c", 1, "n", "h", "k", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# 1


def shingles(t, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(k)
    texts = list(ODD)
    for _ in range(12):
        base = words(rng.choice([3, 8, 60, 150]), rng).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 15) + 1)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(copy))
    texts += texts[-4:]
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), k=k).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert all(got[i].kept == (i == want[i]) for i in got)


def test_open_buckets_are_looked_through_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = words(60, rng, 10**6).split()
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(5):
            copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles(t, 2) for t in texts]
    links = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), k=2).collect()}
    assert [got[i] for i in range(40)] == components(40, links)


def test_common_counts_by_matrix():
    draw = np.random.default_rng(1)
    ones = [np.unique(draw.integers(0, 20_000, 300).astype(np.uint64)) for _ in range(40)]
    pairs = [(i, j) for i in range(40) for j in range(40)]
    assert minhash.common_counts(ones, ones, pairs) == [len(np.intersect1d(ones[i], ones[j])) for i, j in pairs]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    both = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = minhash.near_duplicates(both).collect()
    assert [r.component_id for r in got] == [5] * 4 and sorted(r.kept for r in got) == [False, False, True, True]


def test_components_by_stars(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(300 + i, 301 + i) for i in range(60)]
    want = components(361, links)
    for most in (10, 10**6):
        monkeypatch.setattr("strandloom.plans.components.TASK_EDGES", most)
        got = {r.node: r.root for r in connected_components(spark.createDataFrame([*links, (None, 1)], "u long, v long")).collect()}
        assert [got.get(i, i) for i in range(361)] == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 2


def test_toxicity_finds_held_out_documents_and_their_sentences(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        parts = [words(rng.randrange(5, 15), rng) for _ in range(rng.randrange(2, 9))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            at = rng.randrange(len(parts))
            parts[at] = parts[at] + " " + rng.choice(["nasty", "Vile", "horrid"])
        texts.append(". ".join(parts) + ".")
        labels.append((i, None if i % 50 == 1 else int(bad)))
    texts += ODD
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.with_toxicity(docs(spark, texts), known).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(900) if got[i].held_out]
    assert 200 < len(held) < 400
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    model = spark.sparkContext.broadcast(toxicity.train(docs(spark, texts), known))
    found = docs(spark, ["Fine words here. you horrid nasty vile! more"]).select(toxicity.offending(F.col("text"), model).alias("at")).first().at
    assert [s.start for s in found] == [17]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.with_toxicity(docs(spark, ["a", "b c"]), none).collect()}) == 1
    assert toxicity.with_toxicity(docs(spark, ["a"]).limit(0), none).count() == 0


# 3


def test_repeated_runs_against_brute_force(spark):
    rng = random.Random(6)
    shared = [words(rng.randrange(50, 90), rng, 10**6) for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        parts = [words(rng.randrange(5, 60), rng, 10**6) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, rng.choice(shared))
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    texts += [texts[20], shared[0] + " " + shared[0]]
    seen, want = set(), []
    for t in texts:
        ws = lower(t).split() if t else []
        hit = [False] * len(ws)
        for i in range(len(ws) - 49):
            g = tuple(ws[i : i + 50])
            if g in seen:
                hit[i : i + 50] = [True] * 50
            seen.add(g)
        want.append([w for w, h in zip((t or "").split(), hit) if not h])
    d = docs(spark, texts)
    done = linededup.without_repeats(d)
    assert done.columns == [*[c for c in d.columns if c != "cut"], "cut"]
    got = {r.doc_id: r for r in done.collect()}
    for i, t in enumerate(texts):
        assert (got[i].cut.text is None) == (t is None)
        if t is not None and set(t) - {"\x00", "\x1f"}:
            assert got[i].cut.text.split() == want[i], i
            assert got[i].cut.n_removed == len(t.split()) - len(want[i])
        if t is not None and len(t.split()) == len(want[i]):
            assert got[i].cut.text == t


def test_texts_of_a_batch_are_hashed_together(monkeypatch):
    calls = []
    monkeypatch.setattr(linededup, "word_hashes", lambda *a: calls.append(1) or word_hashes(*a))
    texts = ["a b c d", "a b c d", "", None, "x b c\td y", "x b c\td y", "é b"]
    got = list(linededup.texts_of(pa.array(["cut off", *texts]).slice(1)))
    assert len(calls) == 1 and [t.n for t in got] == [len((t or "").split()) for t in texts]
    assert got[0] is got[1] and got[4] is got[5]
    one, two, three = np.array([1]), np.array([1]), np.array([3])
    assert got[0].equal(one, got[4], two, three).all() and not got[0].equal(one - 1, got[4], two - 1, three).any()
    assert got[0].keys(one, 3) == got[4].keys(two, 3) and got[0].keys(one - 1, 3) != got[4].keys(two - 1, 3)


def test_repeated_rows_are_one_document(spark):
    t = words(80, random.Random(1), 10**6)
    got = linededup.without_repeats(spark.createDataFrame([(3, t), (3, t), (None, t), (9, t)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.cut.n_removed) for r in got) == [("3", 0), ("3", 0), ("9", 80), ("None", 80)]
    assert linededup.without_repeats(docs(spark, [t]).limit(0)).count() == 0


def test_texts_without_an_id_or_of_one_id_are_told_apart(spark):
    rng = random.Random(2)
    passage = words(60, rng, 10**6)
    for id_ in (None, 4):
        rows = [(id_, passage + " one"), (id_, passage + " two"), (id_, passage + " two"), (id_, "x " + passage), (9, passage)]
        d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _doc int, _h int, _runs int")
        done = linededup.without_repeats(d)
        assert done.columns == [*d.columns, "cut"]
        got = done.collect()
        assert all((r["_doc"], r["_h"], r["_runs"]) == (1, 2, 3) for r in got)
        cuts = {(r.doc_id, r.text): r.cut.n_removed for r in got}
        if id_ is None:  # the one with an id comes first
            assert sorted(cuts.values()) == [0, 60, 60, 60] and cuts[9, passage] == 0
        else:
            first = [k for k, n in cuts.items() if n == 0]
            assert sorted(cuts.values()) == [0, 60, 60, 60] and first[0][0] == 4


# 4 and 5

TRICKY = ["a\x0bb\x0cc\x1cd\x85e\xa0f", "<|startoftext|>Hi<|endoftext|> x<|endoftext|>y", "DON'T we'll it's İSTANBUL ΑΣ Σ", "é ́x q̣̇", "aaaaaaaaaaaa !!!!!!! 12345 ½ ②", "日本語 한국어 العربية हिन्दी ก็ 😀👍🏽", "​﻿᠎", "ÀÉǅ ŉ ǰ"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(8)
    texts = ODD + TRICKY + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), 32])) for _ in range(200)) for _ in range(60)]
    d = docs(spark, texts)
    both = {r.doc_id: r for r in bpe.with_bpe(d).collect()}
    counts = {r.doc_id: r for r in bpe.with_token_counts(d, limit=10).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert bytes(both[i].ids) == np.array(ids, "<u4").tobytes(), repr(t)
        assert both[i].decoded == lib.decode(ids, skip_special_tokens=False)
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 10)
    assert d.select(bpe.bpe_decode(bpe.bpe_encode(F.col("text")))).count() == len(texts)
    assert bpe.with_bpe(d.limit(0)).count() == 0 and bpe.with_token_counts(d.limit(0)).count() == 0


def test_token_counts_over_many_blocks(spark, monkeypatch):
    """Blocks of a few documents, rows of a few entries: pieces that blocks share, that run over batches, and odd ones."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "ENTRIES", 40)
    path = bpe.tokenizer_path()
    lib, m = Tokenizer.from_file(path), bpe._merger(path)
    rng = random.Random(4)
    words = ["the", "don't", "x<|endoftext|>y", "<|endoftext|>", "日本語", "a,b;c", "thethethe", "Straße", "\u0301", *("w%d" % i for i in range(60))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(35)] + ["", " \n", "the " * 3000]
    laid = []
    for block in range(0, len(texts), 10):
        held = bpe.Block()
        for i, t in enumerate(texts[block : block + 10]):
            held.add(None if block + i == 3 else block + i, t.encode())
        laid += [r for b in held.rows(block, m) for r in b.to_pylist()]
    packed = [{k: r[k] for k in ("block", "k", "pieces", "odd")} for r in laid if r["pieces"] is not None]
    assert len([r for r in laid if r["data"] is not None]) > 4  # rows of entries are split
    pieces = [r for b in bpe._pieces([pa.RecordBatch.from_pylist(packed)]) for r in b.to_pylist()]
    pieces.sort(key=lambda r: (r["odd"], r["piece"]))
    batches = [pa.RecordBatch.from_pylist(pieces[a : a + 3], schema=bpe._PIECES) for a in range(0, len(pieces), 3)]
    counts = [r for b in bpe._counted(path)(batches) for r in b.to_pylist()]
    rows = [{c: r.get(c) for c in ("block", "k", "data", "ids", "sizes", "counts")} for r in counts + [x for x in laid if x["pieces"] is None]]
    rows.sort(key=lambda r: (r["block"], r["counts"] is None))
    schema = pa.schema([bpe._LAID.field(c) for c in ("block", "k", "data", "ids", "sizes")] + [bpe._COUNTED.field("counts")])
    got = [r for b in bpe._sums(pa.RecordBatch.from_pylist(rows[a : a + 7], schema=schema) for a in range(0, len(rows), 7)) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == [None if i == 3 else i for i in range(len(texts))]
    assert [r["n_bytes"] for r in got] == [len(t.encode()) for t in texts]
    assert [r["n_tokens"] for r in got] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]

    d = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None), (2, "the")], "doc_id long, text string").selectExpr("*", "1 as block", "'x' as pieces", "2 as n_tokens", "3 as k")
    got = sorted(map(tuple, bpe.with_token_counts(d).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_tokens").collect()))
    n = [len(lib.encode(t, add_special_tokens=False).ids) for t in ("the cat", "the")]
    assert got == [(-1, 0, 0), (-1, 7, n[0]), (1, 7, n[0]), (1, 7, n[0]), (2, 3, n[1])]


# 6


def test_phrases_against_brute_force(spark):
    rng = random.Random(3)
    vocab = "gnu general public license apache cc by mit the all rights reserved as x y".split()
    texts = ODD + [rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    got = {r.doc_id: r for r in licenses.with_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
        at, named = [], set()
        for p, name in licenses.PHRASES:
            p = p.encode().split()
            for a in range(len(ws)):
                if ws[a : a + len(p)] == p:
                    at.append(a)
                    named.add(name)
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(ws), len(at), sorted(named)), t
        assert (got[i].first_word, got[i].last_word) == (min(at, default=None), max(at, default=None))
        assert set(got[i].labels) >= named and 0 <= got[i].score <= 1


def test_parts_of_a_template_are_chained(spark):
    t = "x Redistribution and use in source and binary forms, with or, perhaps, without modification, are permitted provided that the following conditions are met: y"
    r = licenses.with_licenses(docs(spark, [t, "redistribution and use"])).orderBy("doc_id").collect()
    assert r[0].labels == ["bsd"] and r[0].n_base == 0 and (r[0].spans[0].a, r[0].spans[0].b) == (1, 23)
    assert r[1].labels == []


def test_notices_of_one_family_are_told_apart(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    texts = [notice.format(x) for x in ("", "Lesser ", "Affero ")] + ["a b " + notice.format("Affero ") + " c d e f g h i j k " + notice.format("")]
    texts += ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."]
    got = [r.labels for r in licenses.with_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["gpl"], ["lgpl"], ["agpl"], ["agpl", "gpl"], ["mit"]]
    assert licenses.with_licenses(docs(spark, texts).limit(0)).count() == 0


# 7


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng.choice([0, 1, 5, 13, 40]), rng, 30) for _ in range(25)] + [None, "...", words(60, rng)]
    texts = ODD + [words(rng.randrange(1, 80), rng, 30) for _ in range(60)]
    items[7] = words(15, rng, 10**6)
    texts += [f"é {items[7]} ü {items[-1]} {items[7]}", f"{words(9, rng)}, {items[-1].upper()}!", " ".join(items[-1].split()[5:30])]
    name = lambda k: None if k % 26 == 7 else f"i{k % 26}"
    bench = spark.createDataFrame([(name(k), t, "z") for k, t in enumerate(items)], "item_id string, text string, hits string")
    for most in (10**6, 120):
        decontaminate.BLOCK_WORDS = most
        decontaminate.blocks.__defaults__ = (most,)
        got = {r.doc_id: r.hits for r in decontaminate.with_hits(docs(spark, texts), bench).collect()}
        for i, t in enumerate(texts):
            ws, hit, found = decontaminate.words_of(t), set(), set()
            for k, item in enumerate(items):
                iw = decontaminate.words_of(item)
                n = min(13, len(iw))
                wins = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else set()
                for a in range(len(ws) - n + 1):
                    if tuple(ws[a : a + n]) in wins:
                        hit |= set(range(a, a + n))
                        found |= {name(k)} - {None}
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(ws), len(hit), sorted(found)), (most, t)
    decontaminate.blocks.__defaults__ = (120_000,)
    r = got[len(texts) - 2]
    assert texts[-2][r.chars[-1].a : r.chars[-1].b] == items[-1].upper()
    none = decontaminate.with_hits(docs(spark, ["a b"]), bench.limit(0)).first().hits
    assert (none.n_words, none.n_hit, none["items"]) == (2, 0, [])


# 8


def test_languages_of_held_out_documents(spark):
    rng = random.Random(7)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ver", "ung"], "cc": ["é", "que", "tion", "eau"]}
    rows = []
    for i in range(300):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(300 + k, t, "aa") for k, t in enumerate(ODD)] + [(None, "ka lo mi", None), (5, "12 34", "aa")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    want = {i: lang for i, _, lang in rows[:300]}
    held = [r for r in got if r.held_out and r.doc_id in want and r.doc_id != 5]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.98 * len(held) > 0
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {300, 301, 302, 306} <= und
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_phrases_of_a_text_by_hand():
    m = langid.Model({"x": ["abcabd"], "y": ["bbbb"]}).built()
    text = langid.symbols_of(b"abdabz", m.symbols)
    # over abcabd: abd, ab, z; over bbbb: a, b, d, a, b, z
    assert m.phrases([text]).tolist() == [[3, 6]]


def test_phrases_of_long_texts_against_a_plain_parse(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(langid, "STRETCH", 16)
    letters = [chr(0x61 + k) for k in range(6)] + [chr(0x4E00 + k) for k in range(90)]
    bank = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    drawn = {x: [" ".join(rng.choice(bank[k * 10 : k * 10 + 20]) for _ in range(60)) for _ in range(4)] for k, x in enumerate("xyz")}
    m = langid.Model(drawn).built()
    texts = [langid.symbols_of(" ".join(rng.choice(bank) for _ in range(n)).encode(), m.symbols) for n in (0, 1, 5, 300, 1200)] + [m.seqs[0][:700]]
    for text, got in zip(texts, m.phrases(texts).tolist()):
        for seq, n in zip(m.seqs, got):
            known, t, at, count = bytes(seq), bytes(text), 0, 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in known:
                    size += 1
                at, count = at + size, count + 1
            assert n == count


def test_samples_are_bounded_whatever_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 3)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(toxicity, "TEXTS", 2)
    rows = [(1, f"text number {k}", "aa") for k in range(50)] + [(3, "same", "bb")] * 40 + [(7, "x", "cc")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(d, F.lit(False))
    assert m.langs == ["aa", "bb"] and len(bytes(m.seqs[1])) == 4 and 0 < len(m.seqs[0]) <= 3 * 12
    sent = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: sent.append((texts, labels)))
    toxicity.train(d, spark.createDataFrame([(1, 1), (3, 0), (8, 1)], "doc_id long, toxic int"))
    assert len(sent[0][0]) <= 4 and all(x in (0, 1) for x in sent[0][1])


def test_languages_of_rare_scripts(spark):
    rng, rows, want = random.Random(8), [], {}
    for base, lang in ((0x61, "aa"), (0x3B1, "bb"), (0x430, "cc"), (0x561, "dd"), (0x10D0, "ee"), (0x5D0, "ff"), (0x4E00, "gg"), (0x5E00, "hh")):
        for _ in range(40 if lang == "aa" else 12):
            i = len(rows)
            text = " ".join("".join(chr(base + rng.randrange(24 if base < 0x4E00 else 900)) for _ in range(4)) for _ in range(900 if lang == "aa" else 60))
            rows.append((i, text, lang))
            want[i] = lang
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert any(r.held_out for r in got) and all(r.lang_pred == want[r.doc_id] for r in got if r.held_out)


def test_spellings_differ_and_every_drawn_text_counts(monkeypatch):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 5000)]
    known = langid.symbol_table(letters)
    assert len({langid.symbols_of(c.encode(), known).tobytes() for c in letters}) == 5000
    monkeypatch.setattr(langid, "SYMBOLS", 20)
    m = langid.Model({"x": ["a" * 50, "bc"], "y": ["d" * 50]})
    assert len(m.seqs[0]) == 20 and len(set(m.seqs[0].tolist())) == 3


# 9

PAGE = """<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul>{menu}</ul></nav><!-- ad --><div class="ad">Buy {n}</div><aside>side</aside>
<{tag}><h1>Title&nbsp;{n} &amp;amp;</h1><p>One <b>bo</b>ld{n}<br>two<p>{body}</p><div class="comments"><p>nice {n}</p></div><form>q</form></{tag}>
<div id="cookie-notice">ok</div><footer>&copy; {n}</footer></body>"""


def test_main_text_with_and_without_an_article_element(spark):
    rows, want = [], {}
    for host, tag in (("a.example", "article"), ("b.example", 'div id="story"')):
        for n in range(6):
            body = "</p><p>".join(f"para {n} {k} &lt;x&gt;" for k in range(n + 1))
            page = PAGE.format(n=n, menu="<li><a href='/'>m</a></li>" * (n + 2), tag=tag, body=body).replace(f"</{tag}>", f"</{tag.split()[0]}>")
            rows.append((len(rows), f"https://{host}/p{n}?x=1", page))
            want[len(want)] = f"Title {n} &amp; One bold{n} two " + " ".join(f"para {n} {k} <x>" for k in range(n + 1))
    rows += [(100, None, None), (101, "odd", ""), (102, "http://a.example/z", "just text & more"), (102, "http://a.example/z", "just text & more"), (103, "http://c.example", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for i, text in want.items():
        assert got[i].text == text, i
    assert got[100].text == got[101].text == "" and got[102].text == "just text & more"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[103].n_chars == 249_999
    assert html.extract(pages.limit(0)).count() == 0


def test_wrapper_has_groups_options_and_slots():
    pages = [f"<body><ul>{'<li>x</li>' * k}</ul><p>v{k}</p>{'<hr>' * (k == 3)}<i>same</i></body>" for k in (2, 3, 4)]
    assert html.expression(html.infer(pages)) == "<body <ul ( <li #text </li )+ </ul <p #text </p ( <hr )? ( </hr )? <i 'same' </i </body"

def test_each_template_of_a_host_has_its_own_wrapper(spark):
    rows, want = [], {}
    for n in range(60):
        top = "<header><h2>Site</h2></header><nav>menu</nav>"
        text = f"first {n} {'x' * (n + 1)}"
        if n % 10 < 7:
            page = f"<body>{top}<div id='story'><h1>Title {n}</h1><div class='body'><p>{text * 9}</p></div><p>Written by us</p></div></body>"
            want[n] = f"Title {n} {text * 9} Written by us"
        else:
            page = f"<body>{top}<div id='page'><div class='entry'><h2>Head {n}</h2><p>{text * 9}</p><ul><li>last {n}</li></ul></div></div></body>"
            want[n] = f"Head {n} {text * 9} last {n}"
        rows.append((n, f"http://d.example/{n}", page))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_what_holds_the_article_is_never_left_out(spark, monkeypatch):
    text = "<p>Some real text {n} {x}</p>"
    shapes = [
        "<body class='single has-sidebar'><article>{t}</article></body>",
        "<body class='post comments-open'><header><h1>Site</h1></header><div>{t}</div></body>",
        "<body><form id='aspnetForm'><header>Top</header><main>{t}<form>search</form></main></form></body>",
        "<body><div class='popup'><h1>Head</h1>{t}</div><div class='comments'><article>" + "a reader {n} " * 40 + "</article></div></body>",
        "<body><article><header><h1>Head</h1></header><iframe src='x'/>{t}</article></body>",
        "<body><article><svg><path d='1'>{t}</article></body>",
        "<body><div class='header'>Site</div><div class='popup'>{t}</div></body>",
        "<body><article><textarea>typed</textarea><template>no</template><p>{n}<iframe src='y'>old</iframe></p>{t}<unknown>tail</unknown></article>",
    ]
    heads = ["", "", "", "Head ", "Head ", "", "", "{n} "]
    rows, want = [], {}
    for k, shape in enumerate(shapes):
        for n in range(3):
            x = "y" * (n + 1)
            rows.append((10 * k + n, None if k == 2 else f"http://h{k}.example/{n}", shape.replace("{t}", text).replace("{n}", str(n)).replace("{x}", x)))
            want[10 * k + n] = heads[k].replace("{n}", str(n)) + f"Some real text {n} {x}" + (" tail" if k == 7 else "")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    monkeypatch.setattr(html, "HOSTS", 0)  # joined by salts
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_marks_are_whole_words_and_never_on_what_holds_the_article(spark):
    rows, want = [], {}
    for n in range(8):
        part = f"<h2 id='related'>Work {n}</h2><section id='social-effects'><p class='notice-of-sale'>sold {n}</p></section><section id='comments'>anchor {n}</section><p class='share'>gone {n}</p>"
        for k, page in enumerate(
            (
                f"<html class='ad'><body class='no-sidebar has-nav'><article class='post comments widget'>{part}</article></body></html>",
                f"<body class='nav'><nav>menu {n}</nav><div class='widget'><div id='story'>{part}</div></div></body>",
            )
        ):
            rows.append((10 * n + k, f"http://{'ab'[k]}.example/{n}", page))
            want[10 * n + k] = f"Work {n} sold {n} anchor {n}"
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


# 10


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        c = draw.standard_normal(24)
        for _ in range(draw.integers(1, 6)):
            rows.append((c + draw.standard_normal(24) * draw.choice([0.05, 0.3, 0.5])).tolist())
    rows += [rows[0], [2 * v for v in rows[0]], None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0], [1e300] * 24, [1.0] * 24]
    d = spark.createDataFrame([(i, v, "n") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, node string")
    links = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if x and y and len(x) == len(y) and all(v is not None and np.isfinite(v) for v in x + y) and any(x) and any(y):
                x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links.append((a, b))
    want, count = components(len(rows), links), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for chunk in (12_000, 9):
        vectors.CHUNK = chunk
        got = {r.vec_id: r for r in vectors.near_vectors(d).collect()}
        assert [(got[i].component_id, got[i].n_links, got[i].kept) for i in range(len(rows))] == [(want[i], count[i], want[i] == i) for i in range(len(rows))]
    vectors.CHUNK = 12_000
    assert vectors.near_vectors(d.limit(0)).count() == 0


def test_comparison_copies_no_vector_to_disk(spark, monkeypatch, tmp_path):
    # many chunks: the rows of the written tables are the vectors and the links, not vectors times chunks
    monkeypatch.setattr(vectors, "CHUNK", 8)
    sizes = []

    def counted(df, *path):
        out = written(df, *path)
        if "raw" in df.columns or "raws" in df.columns:
            sizes.append(out.agg(F.sum(F.length("raws" if "raws" in df.columns else "raw"))).first()[0])
        return out

    monkeypatch.setattr(vectors, "save", counted)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((400, 64)).astype(np.float32)
    x[300:] = x[:100] + 0.05 * draw.standard_normal((100, 64)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    done = vectors.near_vectors(d)
    assert sizes == [400 * 256] * 3
    assert {r.vec_id: (r.n_links, r.component_id) for r in done.collect()} == {i: (int(i < 100 or i >= 300), i - 300 if i >= 300 else i) for i in range(400)}


def test_pigeonhole_budgets_add_up():
    for d in (3, 16, 64, 100):
        parts = vectors.blocks(d, 0.9)
        assert parts[0][0] == 0 and parts[-1][1] == d and abs(sum(p[2] for p in parts) - 0.2) < 1e-12
        q = vectors.rotation(d)
        assert np.allclose(q @ q.T, np.eye(d))


def test_digests_of_queries(spark):
    texts = ["Some text", None]
    d = bpe.with_bpe(docs(spark, texts)).select("doc_id", F.sha2("ids", 256).alias("h")).orderBy("doc_id").collect()
    assert d[1].h == hashlib.sha256(b"").hexdigest()
