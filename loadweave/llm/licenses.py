"""License scans: exact set-similarity joins of text blocks with license templates.

Two kinds of evidence, both found in whole texts:

* phrases: places where a phrase's words stand consecutively;
* blocks: windows of as many words as a template has, whose distinct words contain at
  least ``threshold`` of the template's distinct words.

Blocks are found by a prefix-filtered join.  The templates' words are ordered by their
document frequency over the whole corpus, rarest first.  A block that contains at least
ceil(t * |T|) of |T| words holds one of the rarest |T| - ceil(t * |T|) + 1 (the prefix).  An
index leads from prefix words to their templates, so a text meets only templates that one of
its words calls up (prefix filter); those with too few of their words in the text go (length
filter).  Only windows that begin or end at a template word are counted (positional filter), exactly,
by two pointers; every window between two such places holds the same words.

The templates are a parameter of some hundred words, so each task holds them and their index;
texts never move, and the only shuffle is of the template words' counts.

Defined results: null and empty texts have no words, no labels, no blocks and score 0; every row
gives one row, repeated rows too.  Every block that meets the threshold is found; blocks that start at
consecutive words are one stretch, with its best block.  A block near a text's end may be shorter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_FOLD, batches, columns, table

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Openings of public license notices, by label; blocks of running text are held against these.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3": "is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "agpl-3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "fdl": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cddl": "the contents of this file are subject to the terms of the common development and distribution license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "this work is licensed under the creative commons attribution noderivatives 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "bsl-1": "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software",
    "ofl-1": "this font software is licensed under the sil open font license version 1 1",
    "artistic-2": "this is free software you may redistribute it and or modify it under the terms of the artistic license 2 0",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "ms-pl": "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software",
    "all-rights": "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
THRESHOLD = 0.8
#: Fields of a stretch of blocks.
BLOCK = ("label", "first_word", "n_words", "score", "start", "n_starts")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD).split() if text else []


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of a small vocabulary, over all documents; partial sums before the shuffle."""
    known = frozenset(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = dict.fromkeys(known, 0)
        for frame in frames:
            for text in frame["text"]:
                for word in known.intersection(words(text)):
                    found[word] += 1
        yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in found], "n": list(found.values())})

    rows = columns(docs, text="string").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in rows}


class Template:
    def __init__(self, label: str, text: str, frequency: dict[bytes, int], threshold: float):
        sequence = words(text)
        distinct = sorted(set(sequence), key=lambda w: (frequency.get(w, 0), w))
        self.label, self.span, self.size = label, len(sequence), len(distinct)
        self.need = math.ceil(threshold * self.size - 1e-9)
        self.words = frozenset(distinct)
        self.prefix = frozenset(distinct[: self.size - self.need + 1])

    def blocks(self, text_words: list[bytes], present: set[bytes]) -> list[tuple[int, float, int, int]]:
        """Every block that meets the threshold, as stretches of consecutive starts: first word and containment of a
        stretch's best block (its first template word; the first of equals), the first start and how many there are.

        What a block holds changes only where a template word enters or leaves it, so the starts between are one step.
        """
        if len(self.words & present) < self.need:
            return []
        at = [(i, w) for i, w in enumerate(text_words) if w in self.words]
        held: dict[bytes, int] = {}
        found: list[tuple[int, float, int, int]] = []
        enter = leave = start = 0
        most = first = begin = end = -1
        while leave < len(at):
            while enter < len(at) and at[enter][0] < start + self.span:
                held[at[enter][1]] = held.get(at[enter][1], 0) + 1
                enter += 1
            after = at[leave][0] + 1
            if enter < len(at):
                after = min(after, at[enter][0] - self.span + 1)
            if len(held) >= self.need:
                if start > end:  # apart from the stretch before
                    if most > 0:
                        found.append((first, most / self.size, begin, end - begin))
                    most, begin = 0, start
                if len(held) > most:
                    most, first = len(held), at[leave][0]
                end = after
            start = after
            while leave < enter and at[leave][0] < start:
                gone = at[leave][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                leave += 1
        if most > 0:
            found.append((first, most / self.size, begin, end - begin))
        return found


def phrase_places(found: list[bytes], phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase (blanks around it) begins."""
    joined, out, at, word, seen = b" " + b" ".join(found) + b" ", [], 0, 0, 0
    while (at := joined.find(phrase, at)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at += 1
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: words, phrase places, first and last starts, labels, the best score, and the blocks found.

    ``score`` is 1 where a phrase stands, else the largest containment of a template.  ``blocks`` holds all
    blocks that meet the threshold, by label and place, a row for each stretch of consecutive starts: label, the
    best block's first template word, words and score, the first block's start, and the number of starts.
    """
    frequency = word_frequencies(docs, {w for t in templates.values() for w in words(t)})
    index: dict[bytes, list[Template]] = {}
    for label, text in templates.items():
        template = Template(label, text, frequency, threshold)
        for word in template.prefix:
            index.setdefault(word, []).append(template)
    sought = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]

    def one(text: str | None) -> tuple:
        found = words(text)
        present = set(found)
        starts, base, blocks = [], set(), []
        for phrase, label in sought:
            if places := phrase_places(found, phrase):
                starts += places
                base.add(label)
        called = {t.label: t for word in index.keys() & present for t in index[word]}
        for label in sorted(called):
            blocks += [(label, first, called[label].span, value, begin, n) for first, value, begin, n in called[label].blocks(found, present)]
        score = 1.0 if starts else max((b[3] for b in blocks), default=0.0)
        return (
            len(found), len(starts), min(starts) if starts else None, max(starts) if starts else None,
            ",".join(sorted(base)), ",".join(sorted(base | {b[0] for b in blocks})), score, blocks,
        )

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        for frame in batches(frames, "text", 4 << 20):
            out = pd.DataFrame([one(t) for t in frame["text"]], columns=names)
            out["blocks"] = [[dict(zip(BLOCK, b, strict=True)) for b in found] for found in out["blocks"]]
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, first_word: long, n_words: long, score: double, start: long, n_starts: long>>"
    return columns(docs, doc_id="long", text="string").mapInPandas(scanned, schema)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")
