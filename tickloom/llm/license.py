"""License scans: named phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of twice a template's length, starting at any word. A block meets a template
when it holds at least ``percent`` of the template's different words; blocks that meet it and overlap
are given as one passage with the highest share. The join is exact and filtered: template words are
ordered by how many documents of the whole corpus hold them, rarest first; a document with a block
that meets the threshold must hold one of the template's first ``size - needed + 1`` words (prefix)
and ``needed`` of its words. Only through such documents does the block slide, from template word to
template word with running counts, in time linear in the text. The templates are a bounded
parameter; documents stream through the join and nothing of the corpus is collected but one count
per template word.

Defined cases: null and empty texts have no words and score 0. Repeated rows are scanned each.
Equal frequencies stand in alphabetical order. Other columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public license notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
           "software and associated documentation files",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in "
              "compliance with the license",
    "gpl": "you can redistribute it and or modify it under the terms of the gnu general public "
           "license as published by the free software foundation",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "proprietary": "all rights reserved no part of this work may be reproduced without permission",
}

_SPLIT = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
               for c in range(256))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("containment", pa.float64())]))


@dataclass(frozen=True)
class Scan:
    percent: int = 80
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_SPLIT).split()


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> Counter:
    """Documents of the whole table that hold each word of a bounded vocabulary."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_in(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            ["w", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "w binary, n long")
    return Counter({bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n"))
                    .collect()})


class Template:
    """A template's words in global order, with its filters."""

    def __init__(self, label: str, text: str, percent: int, counts: Counter):
        words = words_in(text)
        self.label, self.step = label, len(words)
        self.words = frozenset(words)
        self.ordered = sorted(self.words, key=lambda w: (counts[w], w))
        self.needed = -(-percent * len(self.words) // 100)
        cut = len(self.words) - self.needed + 1
        self.prefix = frozenset(self.ordered[:cut])

    def blocks(self, words: list[bytes], held: set[bytes]):
        """(start, end, containment) of the passages whose blocks reach the threshold."""
        if held.isdisjoint(self.prefix) or len(held & self.words) < self.needed:
            return
        # A block that starts before a template word holds no more than the one starting at it.
        at = [i for i, w in enumerate(words) if w in self.words]
        inside: Counter = Counter()
        end, passage = 0, None
        for i in at:
            while end < len(at) and at[end] < i + 2 * self.step:
                inside[words[at[end]]] += 1
                end += 1
            both = len(inside)
            if both >= self.needed:
                stop = min(i + 2 * self.step, len(words))
                if passage and i < passage[1]:
                    passage = passage[0], stop, max(passage[2], both / len(self.words))
                else:
                    if passage:
                        yield passage
                    passage = i, stop, both / len(self.words)
            inside[words[i]] -= 1
            if not inside[words[i]]:
                del inside[words[i]]
        if passage:
            yield passage


def scan(docs: DataFrame, rules: Scan = Scan(), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks."""
    vocabulary = {w for t in rules.templates.values() for w in words_in(t)}
    counts = word_counts(docs, vocabulary, text_col)
    templates = [Template(k, t, rules.percent, counts) for k, t in rules.templates.items()]
    phrases = [(words_in(p), label) for p, label in rules.phrases.items()]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("t").to_pylist():
                words = words_in(text)
                held = set(words)
                places, base = [], set()
                for phrase, label in phrases:
                    if held.issuperset(phrase):
                        k = len(phrase)
                        own = [i for i, w in enumerate(words)
                               if w == phrase[0] and words[i: i + k] == phrase]
                        places += own
                        if own:
                            base.add(label)
                blocks = [{"label": t.label, "start": a, "end": b, "containment": c}
                          for t in templates for a, b, c in t.blocks(words, held)]
                labels = base | {b["label"] for b in blocks}
                score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
                rows.append((len(words), len(places), min(places, default=None),
                             max(places, default=None), ",".join(sorted(base)),
                             ",".join(sorted(labels)), round(score, 6), blocks))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                     "score", "blocks"]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["id", *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")
                       ).mapInArrow(run, (
        f"id {id_type}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "blocks array<struct<label:string,start:long,end:long,containment:double>>"
    )).withColumnRenamed("id", id_col)
