"""Benchmark decontamination with spaced seeds.

Fixed masks choose some of the next token positions and ignore the others, so that a substituted word spoils few
hashes; the set of masks misses no overlap that counts. Hashes of the benchmark's masked positions are joined with those of all documents; around each hit the
diagonal is scored, and the best segment, which tolerates substitutions, must hold enough equal words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftlink.llm.common import need, text_slices

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Positions that count are 1. Chosen and tested by enumeration: every segment with LEAST equal words and a
#: share of SHARE, however long, has a place where all positions of one of them are equal words.
MASKS = ("1111111", "11110111", "11101111", "11110100011", "11101001011", "10001011111")
#: Weight and span, at most, of the masks for items of fewer words than LEAST equal ones take.
SHORT_WEIGHT, SHORT_SPAN = 5, 11
#: Equal words that a segment needs (or that many of a shorter item), and the share of its words that must be equal.
LEAST, SHARE, PRICE = 13, 0.8, 4
#: Bytes of benchmark text that a task holds at once; larger benchmarks go in blocks, each against all rows.
BLOCK_BYTES = 8 << 20


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.lower().encode())


def need_of_words(n: int) -> int:
    """Equal words that an item of n words needs."""
    return min(LEAST, int(np.ceil(SHARE * n)))


@cache
def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """Positions of the masks for items of n words: for short ones, masks are taken, the best first, until each set of equal words that is enough is hit."""
    if need_of_words(n) == LEAST:
        return tuple(tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS)
    bits = lambda at: sum(1 << i for i in at)
    left = [bits(c) for c in combinations(range(n), need_of_words(n))]
    of = {m: bits(m) for m in ((0, *c) for c in combinations(range(1, min(n, SHORT_SPAN)), min(SHORT_WEIGHT, need_of_words(n)) - 1))}
    hit = lambda m, words: any(words >> at & of[m] == of[m] for at in range(n - m[-1]))
    out = []
    while left:
        out.append(max(of, key=lambda m: sum(hit(m, w) for w in left)))
        left = [w for w in left if not hit(out[-1], w)]
    return tuple(out)


class Seeds:
    """The masked hashes of one block of a benchmark, sorted, with the places they come from."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        same: dict[bytes, int] = {}
        self.items: list[tuple[list[object], np.ndarray]] = []  # items of equal words are one, with all their ids
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype="uint64")
            if len(ids):
                k = same.setdefault(ids.tobytes(), len(self.items))
                if k == len(self.items):
                    self.items.append(([], ids))
                self.items[k][0].append(item)
        lengths = {len(ids) for _, ids in self.items}
        self.masks = sorted({m for n in lengths for m in masks_for(n)})
        self.tables = []
        for mask in self.masks:
            hashes, places = [], []
            for k, (_, ids) in enumerate(self.items):
                n = len(ids) - mask[-1]
                if mask in masks_for(len(ids)):
                    hashes.append(self.hashed(ids, mask))
                    places.append(np.stack([np.full(n, k), np.arange(n)], axis=1))
            if hashes:
                h, p = np.concatenate(hashes), np.concatenate(places)
                order = np.argsort(h, kind="stable")
                sieve = np.zeros(1 << 20, dtype=bool)
                sieve[h >> np.uint64(44)] = True
                self.tables.append((mask, h[order], p[order], sieve))

    @staticmethod
    def hashed(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        """A hash of each place's masked ids."""
        n = len(ids) - mask[-1]
        out = np.zeros(n, dtype="uint64")
        for at in mask:
            out = (out ^ ids[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def need_of(self, k: int) -> int:
        return need_of_words(len(self.items[k][1]))

    def overlap(self, doc: np.ndarray, k: int, shift: int) -> tuple[int, int, int] | None:
        """The best segment of item k against a document on a diagonal: start in the item, length, equal words; None if too little.

        Of all segments with a share of SHARE or more the one with most equal words, then the shortest, then the first.
        """
        item = self.items[k][1]
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        same = doc[low + shift : high + shift] == item[low:high]
        # An equal word pays 1 and another costs 4: a segment with a sum from 0 has a share of SHARE, 4 of 5, or more.
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PRICE))])
        words = np.concatenate([[0], np.cumsum(same)])
        # Each end takes its farthest start with no higher total, then leaves out unequal words that lead.
        start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        start = np.searchsorted(words, words[start], "right") - 1
        start = np.minimum(start, np.arange(len(total)))
        equal = words - words[start]
        ends = np.flatnonzero(equal == equal.max())
        end = int(ends[np.argmin(ends - start[ends])])
        first, most = int(start[end]), int(equal[end])
        return (low + first, end - first, most) if most >= self.need_of(k) else None

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item's place, start in the document, start in the item, length, equal words) of the best overlap of each row and item."""
        gap = max((m[-1] for m in self.masks), default=0) + 1
        get = self.vocabulary.get
        rows = [np.fromiter(map(get, w, repeat(0)), dtype="uint64", count=len(w)) for t in texts for w in (words_of(t) if t else [],)]
        pad = np.zeros(gap, dtype="uint64")
        ids = np.concatenate([x for r in rows for x in (r, pad)]) if rows else pad
        starts = np.cumsum([0, *(len(r) + gap for r in rows)])
        known = ids > 0
        diagonals = set()
        for mask, table, places, sieve in self.tables:
            n = len(ids) - mask[-1]
            if n <= 0:
                continue
            ok = known[:n].copy()
            for at in mask:
                ok &= known[at : at + n]
            where = np.flatnonzero(ok)
            h = np.zeros(len(where), dtype="uint64")
            for at in mask:
                h = (h ^ ids[where + at]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            sieved = sieve[h >> np.uint64(44)]
            where, h = where[sieved], h[sieved]
            first, last = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            count = last - first
            at = np.repeat(where, count)
            place = places[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            row = np.searchsorted(starts, at, "right") - 1
            shift = at - starts[row] - place[:, 1]
            diagonals.update(map(tuple, np.unique(np.stack([row, place[:, 0], shift], axis=1), axis=0).tolist()))
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for row, k, shift in sorted(diagonals):
            if (found := self.overlap(rows[row], k, shift)) is not None:
                start, length, equal = found
                new = (equal, -length, -(start + shift), start)
                if (row, k) not in best or new > best[row, k]:
                    best[row, k] = new
        return [(row, k, -at, start, -length, equal) for (row, k), (equal, length, at, start) in sorted(best.items())]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Seeds]:
    """The benchmark's seeds in blocks of about ``most`` bytes; null texts, which hold nothing, are left out."""
    full = need(benchmark, item_col, text_col).toDF("item", "text").filter(F.length("text") > 0)
    size = full.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // most))
    for k in range(n):
        part = full if n == 1 else full.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Seeds(sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x[0], x[1])))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_col, doc_start, item_start, length, equal) for every document and item that overlap.

    Places count words from 0. Of several overlaps of a pair the one with most equal words counts, then the shortest,
    then the first. Whole texts are read. Null and empty texts on either side overlap with nothing. Repeated rows on
    either side give a row each; other columns are ignored; an empty table on either side gives an empty table.
    """
    source = need(docs, id_col, text_col)
    kinds = source.schema[0].dataType.simpleString(), need(benchmark, item_col).schema[0].dataType.simpleString()
    item_type = to_arrow_type(need(benchmark, item_col).schema[0].dataType)
    out = None
    for seeds in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                found = [(row, item, *rest) for row, k, *rest in shared.value.hits(batch.column(1).to_pylist()) for item in shared.value.items[k][0]]
                cols = list(zip(*found, strict=True)) or [()] * 6
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                items = pa.array(cols[1], item_type)
                yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(c, pa.int64()) for c in cols[2:])], names=["id", "item", "doc_start", "item_start", "length", "equal"])

        part = source.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, doc_start bigint, item_start bigint, length bigint, equal bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns; no row is moved."""
    at = docs.columns.index(text_col)
    for seeds in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, at):
                hit = {x[0] for x in shared.value.hits(batch.column(at).to_pylist())}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
