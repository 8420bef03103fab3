"""License scans with a positional rare-token index.

Each template is a run of words. A file is looked up by the template's words of the highest IDF over the corpus;
every place of such a word fixes a start for the template, and the postings of its other words are intersected by
relative position. A template is found where enough of its words stand and its key phrases are complete. With
``misses`` words that may be missing, its ``misses + 1`` rarest words are looked up, so no alignment is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftlink.llm.common import need, text_slices

#: Words of the UTF-8 bytes of a text whose A-Z are lower case; bytes from 80 on belong to words.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """label: what it stands for; text: its words; keys: phrases of it that must be complete; share: of its words that must stand."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 0.8
    base: bool = False
    words: tuple[bytes, ...] = field(init=False)
    misses: int = field(init=False)
    must: frozenset[int] = field(init=False)

    def __post_init__(self) -> None:
        words = tuple(WORDS.findall(self.text.lower().encode()))
        must: set[int] = set()
        for key in self.keys:
            part = tuple(WORDS.findall(key.lower().encode()))
            at = next(i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part)
            must.update(range(at, at + len(part)))
        for name, value in (("words", words), ("misses", min(len(words) - math.ceil(self.share * len(words)), len(words) - len(must))), ("must", frozenset(must))):
            object.__setattr__(self, name, value)


#: Phrases and the labels they give.
BASE = (
    Template("cc-by", "cc by", share=1.0, base=True),
    Template("gpl", "general public license", share=1.0, base=True),
    Template("reserved", "all rights reserved", share=1.0, base=True),
)
#: Wordings of well-known licences and their key phrases.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",), 0.6),
    Template("mit", "licensed under the mit license", ("mit license",), 0.6),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "associated documentation files")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "mozilla public license v 2 0", ("mozilla public license",), 0.5),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",), 0.5),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",), 0.5),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",), 0.6),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",), 0.6),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",), 0.6),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",), 0.6),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",), 0.6),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived",)),
    Template("gpl-2.0", "either version 2 of the license or at your option any later version", ("either version 2 of the license",)),
    Template("gpl-3.0", "either version 3 of the license or at your option any later version", ("either version 3 of the license",)),
    Template("lgpl-2.1", "gnu lesser general public license version 2 1", ("lesser general public license version 2 1",)),
    Template("lgpl-3.0", "gnu lesser general public license version 3", ("lesser general public license version 3",)),
    Template("agpl-3.0", "gnu affero general public license version 3", ("affero general public license version 3",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",), 0.6),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, int]:
    """In how many texts each word of the templates stands; a row for each word and task at most is shuffled."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for batch in text_slices(batches, 0):
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                for word in vocabulary.intersection(WORDS.findall(raw.lower())) if raw else ():
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = need(docs, text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in rows}


class Index:
    """For each rare word the places of templates that it fixes."""

    def __init__(self, templates: tuple[Template, ...], df: dict[bytes, int]) -> None:
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = templates
        for k, t in enumerate(templates):
            for i in sorted(range(len(t.words)), key=lambda i: (df.get(t.words[i], 0), t.words[i], i))[: t.misses + 1]:
                self.by_word.setdefault(t.words[i], []).append((k, i))
        self.rare = frozenset(self.by_word)

    def places(self, words: list[bytes]) -> dict[tuple[int, int], float]:
        """The share of template k's words that stand when it starts at a place: {(k, start): share}."""
        found: dict[tuple[int, int], float] = {}
        if self.rare.isdisjoint(words):
            return found
        n = len(words)
        for at in [i for i, w in enumerate(words) if w in self.rare]:
            for k, i in self.by_word[words[at]]:
                start, t = at - i, self.templates[k]
                if (k, start) in found:
                    continue
                stand = {j for j, w in enumerate(t.words) if 0 <= start + j < n and words[start + j] == w}
                if len(stand) >= len(t.words) - t.misses and t.must <= stand:
                    found[k, start] = len(stand) / len(t.words)
        return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + TEMPLATES, df: dict[bytes, int] | None = None) -> DataFrame:
    """(id_col, n_words, matches) of every row; matches: label, base, start (in words from 0) and score, by start, label and score.

    Whole texts are read. A null or empty text has no words and no matches. Words never touch letters' case beyond
    A-Z. Repeated rows give a row each; other columns are ignored, whatever their names; an empty table gives an
    empty table. Words of equal frequency rank by their bytes, then by position; that choice can't change results.
    """
    index = Index(templates, document_frequencies(docs, templates, text_col) if df is None else df)
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, matches = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = WORDS.findall(raw.lower()) if raw else []
                counts.append(len(words))
                found = [(start, t.label, share, t.base) for (k, start), share in index.places(words).items() for t in (templates[k],)]
                matches.append([{"label": label, "base": base, "start": start, "score": share} for start, label, share, base in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, kind)], names=["id", "n_words", "matches"])

    source = need(docs, id_col, text_col)
    of_id = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {of_id}, n_words bigint, matches array<struct<label:string,base:boolean,start:bigint,score:double>>").withColumnRenamed("id", id_col)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the result of scan()."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    return scanned.select(
        F.col(id_col), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
