"""Licence scans with a positional rare-token index (operator 9).

Templates are licence notices, cut into words like the files.  The index posts every template word
with its place.  Document frequencies of the template words are counted over the whole corpus, which
ranks them by IDF.  For each file the template words it holds are looked up from the rarest on; every
posting votes for (template, place in file - place in template), and a template qualifies where the
votes at one offset (a few places of slack for edits) carry enough of its IDF weight.  It is
accepted only if its mandatory key phrases stand there word by word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null and empty texts have no
words, no labels and score 0.  Repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed_text, slices

#: Fixed phrases and the labels they stand for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label -> (notice, mandatory key phrases)
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "mit": ("Released under the MIT License", ["mit license"]),
    "mit-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    "lgpl": ("licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    "agpl": ("licensed under the GNU Affero General Public License", ["affero general public license"]),
    "cc-by-4.0": ("Licensed under CC BY 4.0", ["cc by 4 0"]),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    "cc0": ("Dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify and or distribute"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}
#: Template words looked up per file, rarest first, before a template must have qualified.
RARE_WORDS = 6
#: Share of a template's IDF weight that must lie at one offset, and how far places may drift.
MIN_SHARE, SLACK = 0.6, 2
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def templates() -> dict[str, tuple[list[bytes], list[list[bytes]]]]:
    return {k: (words_of(t), [words_of(p) for p in phrases]) for k, (t, phrases) in TEMPLATES.items()}


def document_frequencies(df: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each template word, over the whole corpus; the vocabulary is a fixed few hundred words."""
    vocabulary = frozenset(w for words, _ in templates().values() for w in words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count = 0, defaultdict(int)
        for b in slices(batches):
            n += b.num_rows
            for t in b.column("text").to_pylist():
                for w in vocabulary.intersection(words_of(t)):
                    count[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(["", *(w.decode() for w in count)], pa.string()),
                                          "n": pa.array([n, *count.values()], pa.int64())})

    src = df.select(F.col(text_col).cast("string").alias("text"))
    return {r["word"].encode(): r["n"] for r in
            src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Postings word -> [(template, place)], and IDF weights from the corpus."""

    def __init__(self, frequencies: dict[bytes, int]):
        self.templates = templates()
        n = frequencies.get(b"", 0)
        self.idf = {w: math.log((1 + n) / (1 + frequencies.get(w, 0))) + 1e-3 for words, _ in self.templates.values() for w in words}
        self.weight = {k: sum(self.idf[w] for w in words) for k, (words, _) in self.templates.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for k, (words, _) in self.templates.items():
            for place, w in enumerate(words):
                self.postings[w].append((k, place))
        self.vocabulary = frozenset(self.idf)
        self.phrases = {tuple(words_of(p)): label for p, label in BASE_PHRASES.items()}
        self.first = frozenset(p[0] for p in self.phrases)
        #: the rarest words of every template: a file without any of them cannot qualify
        self.rare = frozenset(w for words, _ in self.templates.values()
                              for w in sorted(set(words), key=lambda w: (-self.idf[w], w))[:RARE_WORDS])

    def base(self, words: list[bytes], present: frozenset[bytes]) -> tuple[list[int], set[str]]:
        """Starts of all base phrases and their labels."""
        starts, labels = [], set()
        for phrase, label in self.phrases.items():
            if not present.issuperset(phrase):
                continue
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if tuple(words[at:at + len(phrase)]) == phrase:
                    starts.append(at)
                    labels.add(label)
        return starts, labels

    def match(self, words: list[bytes], present: frozenset[bytes]) -> dict[str, float]:
        """Accepted templates with the largest share of their IDF weight found at one offset."""
        if not present & self.rare:
            return {}
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        votes: dict[tuple[str, int], dict[int, float]] = defaultdict(dict)
        for w in sorted(present, key=lambda w: (-self.idf[w], w)):
            for template, place in self.postings[w]:
                if w in self.rare:  # rare words open offsets, the others only add to open ones
                    for i in places[w]:
                        votes[template, i - place][place] = self.idf[w]
                elif any(t == template for t, _ in votes):
                    for i in places[w]:
                        if (template, i - place) in votes:
                            votes[template, i - place][place] = self.idf[w]
        out: dict[str, float] = {}
        for (template, offset), own in votes.items():
            near = dict(own)
            for d in range(-SLACK, SLACK + 1):
                for place, v in votes.get((template, offset + d), {}).items():
                    near.setdefault(place, v)
            share = sum(near.values()) / self.weight[template]
            if share < MIN_SHARE or share <= out.get(template, 0):
                continue
            length = len(self.templates[template][0])
            region = words[max(0, offset - SLACK):offset + length + SLACK]
            if all(_holds(region, p) for p in self.templates[template][1]):
                out[template] = min(1.0, share)
        return out


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i:i + n] == phrase for i in range(len(words) - n + 1))


def scan(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: counts, base labels, all labels and the best template share."""
    src = keyed_text(df, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = src.sparkSession.sparkContext.broadcast(index)  # the templates, a constant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        wanted = ix.vocabulary | {w for p in ix.phrases for w in p}
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column("text").to_pylist():
                words = words_of(t)
                present = wanted.intersection(words)
                starts, base = ix.base(words, present) if present else ([], set())
                found = ix.match(words, present & ix.vocabulary) if present else {}
                for c, v in zip(cols, (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                       ",".join(sorted(base)), ",".join(sorted(base | set(found))), max(found.values(), default=0.0)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                               "base_labels string, labels string, score double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, Index(document_frequencies(docs)))
