"""Licence scans with a positional index of rare words.

Every template is a run of words with a mandatory key phrase in it. The index holds the rarest words of each key
phrase with their positions; how rare a word is comes from the document counts of all files. In a file these
licence words are looked up, the rarest first: each place of such a word, less its position in the template, is a
place where the template may start. Starts are intersected over the template's indexed words. At those left, the key
phrase is verified word for word and the template's other words are compared at their own places, weighted by
rarity: the template counts where that weight reaches its share.

Nothing is missed by the index: every place that passes holds the whole key phrase, and so each of its rarest words,
whichever they are. The base phrases are templates that are all key.

Null text counts as empty. A file without words has no labels and score 0. Repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pulsecheck.llm.common import batch_of, byte_texts, fields, per_slice, pick, words_of


@dataclass(frozen=True)
class Template:
    """`label` is given where `share` of the weight of `text` stands at one place and `key` stands in it."""

    label: str
    text: str
    key: str
    share: float = 1.0

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text.encode())


#: Fixed values of the contract.
BASE = [
    Template("mit", "mit license", "mit license"),
    Template("apache", "apache license", "apache license"),
    Template("gpl", "general public license", "general public license"),
]

#: Passages by which licences are known.
TEMPLATES = [
    Template("agpl-3.0", "GNU Affero General Public License version 3", "affero general public license", 0.9),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0", 0.7),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", 0.7),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0", 0.7),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0", 0.7),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4 0", 0.7),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0", 0.7),
    Template("cc0-1.0", "CC0 1.0 Universal", "cc0 1 0", 0.7),
    Template("epl-2.0", "Eclipse Public License version 2.0", "eclipse public license", 0.7),
    Template("gpl-2.0", "GNU General Public License, version 2", "general public license version 2", 0.8),
    Template("gpl-3.0", "GNU General Public License, version 3", "general public license version 3", 0.8),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted", 0.7),
    Template("lgpl", "GNU Lesser General Public License", "lesser general public license", 0.8),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", 0.7),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0", 0.7),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software", 0.7),
]

#: So many of the rarest words of a key phrase are indexed.
RARE = 2


def document_counts(rows: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of files and, for each word of the (fixed) vocabulary, that of files with it, over all files."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def count(batches):
        files, found = 0, Counter()
        for batch in batches:
            from pulsecheck.llm.common import slices

            for part in slices(batch):
                for t in byte_texts(part.column("text")):
                    files += 1
                    found.update(vocabulary.intersection(words_of(t)))
        names = [w.decode() for w in found]
        yield batch_of(("word", pa.array([*names, ""], pa.string())), ("n", pa.array([*found.values(), files], pa.int64())))

    total = rows.select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"].encode(): r["n"] for r in total.collect()}  # a row for each word of the templates
    return counts.pop(b"", 0), counts


class Index:
    def __init__(self, templates: list[Template], files: int, counts: dict[bytes, int], rare: int = RARE):
        self.rarity = {w: math.log((files + 1) / (counts.get(w, 0) + 1)) + 1 for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}
        self.templates, self.indexed = [], []
        for number, t in enumerate(templates):
            words = t.words
            key = words_of(t.key.encode())
            weight = [self.rarity[w] for w in words]
            first = min((i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key), default=-1)
            if first < 0:
                raise ValueError(f"the key phrase of {t.label} is no part of its text")
            self.templates.append((t.label, words, weight, sum(weight), first, key, t.share))
            order = sorted(range(first, first + len(key)), key=lambda i: (-weight[i], i))[:rare]
            for nth, i in enumerate(order):
                self.postings.setdefault(words[i], []).append((number, i, nth))
            self.indexed.append(len(order))
        self.anchors = frozenset(self.postings)

    def places(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """For each template found, its starts and the share of its weight there."""
        if self.anchors.isdisjoint(words):
            return {}
        met = [(self.rarity[w], at, w) for at, w in enumerate(words) if w in self.anchors]
        met.sort(key=lambda m: (-m[0], m[1]))
        proposed: dict[tuple[int, int], set[int]] = {}
        for _, at, w in met:
            for number, place, nth in self.postings[w]:
                proposed.setdefault((number, at - place), set()).add(nth)
        out: dict[int, dict[int, float]] = {}
        for (number, start), by in proposed.items():
            if len(by) == self.indexed[number]:
                _, own, weight, total, first, key, share = self.templates[number]
                if start + first < 0 or words[start + first : start + first + len(key)] != key:
                    continue
                same = sum(x for i, x in enumerate(weight) if 0 <= start + i < len(words) and words[start + i] == own[i])
                if same >= share * total * (1 - 1e-12):
                    out.setdefault(number, {})[start] = min(1.0, same / total)
        return out


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[Template] = BASE, templates: list[Template] = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every row.

    places: label:word of every place found, by place and label; score: the largest share of weight found.
    """
    rows = pick(docs, key, text)
    every = [*base, *templates]
    files, counts = document_counts(rows, {w for t in every for w in t.words})
    n_base = len(base)

    def make():
        index = Index(every, files, counts)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in range(8)]
            for t in byte_texts(batch.column("text")):
                words = words_of(t)
                found = index.places(words)
                starts = [s for number, at in found.items() if number < n_base for s in at]
                named = sorted((s, index.templates[number][0]) for number, at in found.items() for s in at)
                base_labels = sorted({index.templates[number][0] for number in found if number < n_base})
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(sorted({label for _, label in named})))
                row += (max((x for at in found.values() for x in at.values()), default=0.0), ",".join(f"{label}:{s}" for s, label in named))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            return batch_of(("key", batch.column("key")), *((n, pa.array(c, k)) for n, c, k in zip(names, out, kinds)))

        return step

    schema = fields(rows, "key", ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("places", "string"))
    return per_slice(rows, make, schema).withColumnRenamed("key", key)
