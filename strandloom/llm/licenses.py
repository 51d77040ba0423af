"""Licence scans: matching statistics of a generalised suffix automaton of licence words, chained into covered template spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_MAP, table

#: Phrases that name a licence by themselves.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Openings and disclaimers of public licence notices, matched in part too.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
)
#: A template counts when chained matches of at least CHAIN words cover this share of it, with gaps of at most GAP words.
COVER, CHAIN, GAP = 0.75, 3, 8


class Automaton:
    """Suffix automaton of several word sequences; each state knows where in which sequence it ends."""

    def __init__(self, sequences: list[list[bytes]]):
        self.code = {w: k for k, w in enumerate(sorted({w for s in sequences for w in s}), 1)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        tips = []
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq, 1):
                last = self._extend(last, self.code[w])
                tips.append((last, k, i))
        self.tips = {(k, i): state for state, k, i in tips}
        for state, k, i in tips:
            while state > 0:
                self.ends[state].append((k, i))
                state = self.link[state]

    def _add(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.len.append(length)
        self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        made, p = self._add(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        self.link[made] = 0 if p < 0 else self._split(p, self.next[p][c], c)
        return made


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(t.encode().split(), name) for t, name in phrases]
        self.all = self.phrases + [(t.encode().split(), name) for t, name in templates]
        self.auto = Automaton([w for w, _ in self.all])
        self.found: list[list[int]] = [[] for _ in self.auto.len]
        for k, (w, _) in enumerate(self.phrases):
            self.found[self.auto.tips[k, len(w)]].append(k)
        for state in sorted(range(1, len(self.found)), key=self.auto.len.__getitem__):  # a phrase may end a longer match
            self.found[state] = sorted({*self.found[state], *self.found[self.auto.link[state]]})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places of phrases as (start, phrase), and covered spans as (start, end, template, share)."""
        get, onward, link, longest, found = self.auto.code.get, self.auto.next, self.auto.link, self.auto.len, self.found
        base: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        state = size = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                if size >= CHAIN:
                    matches.append((i, size, state))
                state = size = 0
                continue
            if c not in onward[state]:
                if size >= CHAIN:
                    matches.append((i, size, state))
                while state and c not in onward[state]:
                    state = link[state]
                    size = longest[state]
                if c not in onward[state]:
                    state = size = 0
                    continue
            state = onward[state][c]
            size += 1
            for k in found[state]:
                if size >= len(self.phrases[k][0]):
                    base.append((i + 1 - len(self.phrases[k][0]), k))
        if size >= CHAIN:
            matches.append((len(words), size, state))
        return base, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Matches (end, words, state) whose places in a template follow each other grow into one span."""
        open_: dict[int, list[int]] = {}
        out: list[tuple[int, int, int, float]] = []

        def close(k: int) -> None:
            a, b, _, covered = open_.pop(k)
            share = covered / len(self.all[k][0])
            if share >= COVER:
                out.append((a, b, k, min(1.0, share)))

        for end, size, state in matches:
            best: dict[int, int] = {}
            for k, at in self.auto.ends[state]:
                if k not in best or k in open_ and not (best[k] - size >= open_[k][2] - 1) and at - size >= open_[k][2] - 1:
                    best[k] = at
            for k, at in best.items():
                if k in open_ and (end - size - open_[k][1] > GAP or at - size < open_[k][2] - 1 or at - size - open_[k][2] > GAP):
                    close(k)
                if k in open_:
                    a, b, to, covered = open_[k]
                    open_[k] = [a, end, at, covered + min(size, at - to)]
                else:
                    open_[k] = [end - size, end, at, size]
        for k in list(open_):
            close(k)
        return self.strongest(out)

    def strongest(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of spans that overlap (notices of one family share most words) the one with the most covered words, then the larger share."""
        kept: list[tuple[int, int, int, float]] = []
        for span in sorted(spans, key=lambda s: (-round(s[3] * len(self.all[s[2]][0])), -s[3], s)):
            i = bisect(kept, span)
            if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or span[1] <= kept[i][0]):
                kept.insert(i, span)
        return kept

    def report(self, words: list[bytes]) -> dict:
        base, spans = self.scan(words)
        starts = [a for a, _ in base]
        named = {self.phrases[k][1] for _, k in base}
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": sorted(named), "labels": sorted(named | {self.all[k][1] for *_, k, _ in spans}),
            "score": 1.0 if base else max((s for *_, s in spans), default=0.0),
            "spans": [{"a": a, "b": b, "label": self.all[k][1], "share": s} for a, b, k, s in spans],
        }


FOUND = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,labels:array<string>,score:double,spans:array<struct<a:bigint,b:bigint,label:string,share:double>>>"
_FOUND_PA = pa.struct([
    *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))),
])


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def license_scan(text: Column) -> Column:
    """A struct for each whole text: counts and places of the phrases, labels, score and covered word spans [a, b).

    Null and empty texts have no words, no labels, score 0 and null places; the score is 1 where a phrase stands, else
    the largest covered share of a template. Equal places are counted once for each phrase.
    """

    @F.arrow_udf(FOUND)
    def scan(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _scanner()
        for col in cols:
            yield pa.array([find.report((x.as_py() or b"").translate(WORD_MAP).split()) for x in col.cast(pa.large_binary())], _FOUND_PA)

    return scan(text)


def with_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fields of license_scan() for each row; repeated rows each have a result, a null id stays null; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), license_scan(F.col(text_col).cast("string")).alias("found")).select("doc_id", "found.*")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
