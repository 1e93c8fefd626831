"""License notices in texts by an exact set-similarity join of text blocks with notice templates.

A text is a sequence of words (runs of letters and digits, A to Z lower-cased; other scripts count as letters). Its blocks
are the runs of ``2 * STEP`` words that start at every ``STEP``-th word, so every passage of up to ``STEP`` words
lies whole in one block. A block meets a template if it holds at least ``CONTAINMENT`` of the template's distinct words.

The join is exact. Words are ordered by their number in the whole corpus, rarest first. To hold ``c`` of the ``t`` words of
a template, a block must hold one of the template's first ``t - c + 1`` words (prefix filter), must hold ``c`` words of the
vocabulary at all (length filter), and at the first common word enough words must be left on both sides (positional
filter). Only what passes is counted. Words outside of all templates cannot be common to both sides, so blocks are reduced to
the vocabulary of the templates, whose size bounds the frequency table and everything that is sent to tasks.

Where a block meets two templates and the words of one include those of the other, only the larger counts. Besides, all
places of short exact phrases are reported. Both passes are maps over whole texts; only the counts are shuffled.

A null text has no words. Null ids and repeated rows pass through, a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from riskloom.llm.common import append_columns, blocks, byte_sizes

#: Words between the starts of two blocks of a text; at least the length of the longest template.
STEP = 64
CONTAINMENT = Fraction(9, 10)
#: Bytes of one text that are split into words at once.
_SEGMENT = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Exact phrases and the labels they give.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Common licence statements and notices.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(data):
        stop = at + _SEGMENT
        while stop < len(data):  # a segment ends behind a word
            match = _WORD.match(data, stop - 1)
            if match is None or match.end() <= stop:
                break
            stop = match.end()
        yield _WORD.findall(data, at, stop)
        at = stop


class Templates:
    """Distinct words of each template, the least number of common words, and the vocabulary with a number for each word."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], containment: Fraction, step: int):
        split = lambda s: [w for part in words_of(s) for w in part]
        self.step = step
        self.labels = [label for label, _ in templates]
        self.sets = [sorted(set(split(text))) for _, text in templates]
        if any(not 0 < len(split(text)) <= step for _, text in templates):
            raise ValueError("a template needs a word, and at most as many as a step has")
        self.least = [-(-len(s) * containment.numerator // containment.denominator) for s in self.sets]
        self.larger = [[k for k, other in enumerate(self.sets) if set(own) < set(other)] for own in self.sets]
        self.phrases = [(split(text), label) for text, label in phrases]
        self.words = sorted({w for s in self.sets for w in s} | {w for p, _ in self.phrases for w in p})
        self.number = {w: i for i, w in enumerate(self.words)}

    def numbers(self, text: str | None) -> np.ndarray:
        """For each word of a text its number in the vocabulary, -1 for other words."""
        get = self.number.get
        parts = [np.fromiter((get(w, -1) for w in part), np.int16, len(part)) for part in words_of(text or "")]
        return np.concatenate(parts) if parts else np.zeros(0, np.int16)


class Join:
    """The templates in global order of frequency, indexed by the words of their prefixes."""

    def __init__(self, templates: Templates, counts: list[int]):
        self.t = templates
        order = sorted(range(len(counts)), key=lambda w: (counts[w], templates.words[w]))
        self.rank = np.empty(len(counts), dtype=np.int64)
        self.rank[order] = np.arange(len(counts))
        self.sorted_sets = [np.sort(self.rank[[templates.number[w] for w in s]]) for s in templates.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, (own, least) in enumerate(zip(self.sorted_sets, templates.least)):
            for i, r in enumerate(own[: len(own) - least + 1].tolist()):
                self.index.setdefault(r, []).append((k, i))
        self.in_prefix = np.zeros(len(counts) + 1, dtype=bool)
        self.in_prefix[:-1] = [r in self.index for r in self.rank.tolist()]

    def block(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """(template, common words) of the templates that a block meets. ``numbers``: its words in the vocabulary."""
        own = np.unique(self.rank[numbers])
        n, seen, met = len(own), set(), []
        least = self.t.least
        for j, r in enumerate(own.tolist()):
            for k, i in self.index.get(r, ()):
                # The first common word of prefix and block decides: later ones have fewer words behind them.
                if k in seen:
                    continue
                seen.add(k)
                c, size = least[k], len(self.sorted_sets[k])
                if n < c or min(size - i, n - j) < c:
                    continue
                common = len(np.intersect1d(own, self.sorted_sets[k], assume_unique=True))
                if common >= c:
                    met.append((k, common))
        found = {k for k, _ in met}
        return [(k, common) for k, common in met if not found.intersection(self.t.larger[k])]

    def document(self, numbers: np.ndarray) -> list[tuple[int, str, float]]:
        """(first word of the block, label, containment) of all blocks of a text that meet a template."""
        step, n = self.t.step, len(numbers)
        at = np.flatnonzero(self.in_prefix[numbers])
        if not len(at):
            return []
        last = max(0, -(-n // step) - 2)  # number of the last block
        touched = np.unique(np.concatenate((at // step, at // step - 1)))
        out = []
        for b in touched[(touched >= 0) & (touched <= last)].tolist():
            part = numbers[b * step:(b + 2) * step]
            for k, common in sorted(self.block(part[part >= 0])):
                out.append((b * step, self.t.labels[k], common / len(self.sorted_sets[k])))
        return out

    def phrases(self, numbers: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of all places of the exact phrases, in order."""
        out = []
        for words, label in self.t.phrases:
            here = np.ones(max(0, len(numbers) - len(words) + 1), dtype=bool)
            for k, w in enumerate(words):
                here &= numbers[k:k + len(here)] == self.t.number[w]
            out += [(p, label) for p in np.flatnonzero(here).tolist()]
        return sorted(out)


def word_counts(df: DataFrame, text: str, templates: Templates) -> list[int]:
    """How often each word of the vocabulary stands in all texts. Tasks add up before anything is shuffled."""
    def run(batches):
        total = np.zeros(len(templates.words) + 1, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in blocks(byte_sizes(column)):
                for one in column.slice(start, stop - start).to_pylist():
                    total += np.bincount(templates.numbers(one) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) - 1), pa.int64()), pa.array(total[1:])], names=["word", "n"])

    schema = StructType([StructField("word", LongType()), StructField("n", LongType())])
    counts = dict(df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n")).collect())
    return [counts.get(w, 0) for w in range(len(templates.words))]


_PLACE = StructType([StructField("word", LongType()), StructField("label", StringType())])
_MATCH = StructType([StructField("word", LongType()), StructField("label", StringType()), StructField("containment", DoubleType())])


def notices(df: DataFrame, text: str, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None,
            containment: Fraction = CONTAINMENT, step: int = STEP) -> DataFrame:
    """Rows of ``df`` with ``n_words``, ``places`` (first word and label of each exact phrase, in order) and ``matches``
    (first word of the block, label and containment of each block and template that meet)."""
    held = Templates(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, containment, step)
    join = Join(held, word_counts(df, text, held))
    added = StructType([StructField("n_words", LongType()), StructField("places", ArrayType(_PLACE)), StructField("matches", ArrayType(_MATCH))])
    kinds = [pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
             pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]

    def make():
        def work(texts):
            n, places, matches = [], [], []
            for one in texts:
                numbers = held.numbers(one)
                n.append(len(numbers))
                places.append([dict(zip(("word", "label"), p)) for p in join.phrases(numbers)])
                matches.append([dict(zip(("word", "label", "containment"), m)) for m in join.document(numbers)])
            return [pa.array(n, pa.int64()), pa.array(places, kinds[0]), pa.array(matches, kinds[1])]

        return work

    return append_columns(df, text, added, make)


def report(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """A row per document: doc_id, n_words, n_base (places of phrases), first_word, last_word (their least and greatest
    start), base_labels, labels (of phrases and templates; sorted, comma-joined), score (1 if a phrase stands there, else
    the greatest containment of a template met, else 0)."""
    found = notices(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("__text")), "__text")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "matches.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"))
