"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Each task splits its texts into pieces. The pieces that it does not remember become token-position rows in an
in-process DuckDB, which join the table of merges; a recursive query contracts every piece's leftmost pair of
minimum rank until no pair of it can merge. An ordered aggregation over (document, position, id) rows decodes.

A long piece contracts at many places at once. A pair of rank r has a reach, the length of the longest token of rank
r or less that the piece's bytes can make up. Where no lower rank lies within it on either side, no merge that comes
before the pair's own can touch it, since the token that did would be longer than that. The rounds that a piece needs
so depend on the vocabulary, not on the piece's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftlink.llm.common import need, text_slices

#: Bytes from which a piece contracts at many places at once, and its rounds in a query.
LONG, ROUNDS = 200, 8
#: Bytes of long pieces contracted together, or one longer piece, and DuckDB's bytes of memory for each of theirs.
LONG_AT_ONCE, LONG_BYTES = 128 << 10, 1200


@dataclass(frozen=True)
class Room:
    """A worker's tables: pieces in each of the two generations that it remembers, pieces handed to DuckDB at once, tokens decoded at once, bytes of text encoded together, DuckDB's memory in MB."""

    generation: int = 300_000
    at_once: int = 60_000
    tokens_at_once: int = 200_000
    text_at_once: int = 4 << 20
    memory_mb: int = 200


#: For workers that have other stages' memory to carry: about 110 MB less, for more pieces contracted again.
TIGHT = Room(120_000, 12_000, 60_000, 3 << 19, 160)
#: Fixed value: a pattern each of whose matches is white space, or a single space at most and then no white space. Texts can be cut before a space that white space neither precedes nor follows.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: One merge of each piece at a time. ``place`` packs (piece, position); a key packs (rank, position, next position), so that min() finds the leftmost pair of minimum rank.
CONTRACT = """
WITH RECURSIVE s(place, id, go) AS (
  SELECT place, id, true FROM base
  UNION ALL
  SELECT * FROM (
    WITH near AS (
      SELECT *, place >> 23 AS w, lead(place) OVER o AS next_place, lead(id) OVER o AS next_id FROM s WHERE go WINDOW o AS (ORDER BY place)
    ), best AS (
      SELECT w, min((m.id::BIGINT << 46) | ((place & 8388607) << 23) | (next_place & 8388607)) AS k
      FROM near JOIN merges m ON m.pair = ((near.id::BIGINT << 32) | near.next_id) WHERE next_place >> 23 = w GROUP BY w
    )
    SELECT place, CASE WHEN (place & 8388607) = ((k >> 23) & 8388607) THEN (k >> 46)::INTEGER ELSE id END, k IS NOT NULL
    FROM near LEFT JOIN best USING (w)
    WHERE k IS NULL OR (place & 8388607) <> (k & 8388607)
  )
)
SELECT place, id FROM s WHERE NOT go ORDER BY place
"""

#: For long pieces, on one axis with gaps: every pair that no lower rank is within its reach of, on either side, merges.
#: Of a run of overlapping pairs of equal rank every second one from its start merges, where all up to there are least
#: in their surroundings. A token that is part of a lower-ranked one (``early``) could give way to that before its
#: equals merge, so only the leftmost within reach does. ``n`` counts rounds, ``merged`` the merges of the last one.
CONTRACT_LONG = """
WITH RECURSIVE s(place, id, n, merged) AS (
  SELECT place, id, 0, 1::BIGINT FROM base
  UNION ALL
  SELECT * FROM (
    WITH near AS (
      SELECT place, id, n, lead(place) OVER o - place AS size, lead(id) OVER o AS next_id FROM s WHERE merged > 0 AND n < {rounds} WINDOW o AS (ORDER BY place)
    ), pairs AS (
      SELECT near.place, near.place + size AS next_place, m.id AS rank, m.early, m.reach, m.reach + size AS right_reach FROM near JOIN long_merges m ON m.pair = ((near.id::BIGINT << 32) | near.next_id) WHERE size <= {longest}
    ), around AS (
      SELECT *, row_number() OVER o AS k, lag(rank) OVER o AS before, lag(next_place) OVER o AS before_end,
        min(rank) OVER (ORDER BY place RANGE BETWEEN reach PRECEDING AND 1 PRECEDING) AS left_least,
        min(rank) OVER (ORDER BY place RANGE BETWEEN 1 FOLLOWING AND right_reach FOLLOWING) AS right_least
      FROM pairs WINDOW o AS (ORDER BY place)
    ), least AS (
      SELECT *, rank <= coalesce(left_least, rank) AND rank <= coalesce(right_least, rank) AS hit, (before = rank AND before_end = place) IS TRUE AS follows FROM around
    ), runs AS (
      SELECT *, max(CASE WHEN NOT follows THEN k END) OVER p AS first, max(CASE WHEN NOT hit THEN k END) OVER p AS missed FROM least WINDOW p AS (ORDER BY place ROWS UNBOUNDED PRECEDING)
    ), merging AS (
      SELECT place, next_place, rank, count(*) OVER () AS total FROM runs WHERE hit AND CASE WHEN early = 1 THEN left_least IS NULL OR rank < left_least ELSE coalesce(missed, 0) < first AND (k - first) % 2 = 0 END
    )
    SELECT near.place, coalesce(m.rank, near.id)::INTEGER, near.n + 1, coalesce((SELECT any_value(total) FROM merging), 0)::BIGINT
    FROM near LEFT JOIN merging m ON m.place = near.place ANTI JOIN merging g ON g.next_place = near.place
  )
)
SELECT place, id, merged FROM s WHERE n = (SELECT max(n) FROM s) ORDER BY place
"""

DECODE = """
SELECT d, list(bytes ORDER BY p) AS parts FROM tokens JOIN vocab USING (id) GROUP BY d ORDER BY d
"""


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Generation:
    """Pieces by number, and the ids of each number in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.zeros(0, "int64")
        self.ids = np.zeros(0, "<i4")

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Coder:
    """The tables of one vocabulary in an in-process DuckDB with one thread and bounded memory.

    Pieces are remembered in two generations: when the younger is full it becomes the older, whose pieces are taken
    over where they are met again, so that what is common stays.
    """

    def __init__(self, ranks: bytes, pattern: str, room: Room = Room()) -> None:
        import duckdb
        import regex

        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        if any(bytes([i]) not in rank for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        if max(rank.values()) >= 1 << 17:
            raise ValueError("at most 131,072 ranks fit the packed keys")
        self.room = room
        self.rank, self.pieces = rank, regex.compile(pattern).findall
        self.spaced, self.uncut = pattern == SPACED, regex.compile(r" \s").search
        self.byte_ids = np.array([rank[bytes([i])] for i in range(256)], dtype="int32")
        self.young, self.old = Generation(), Generation()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{self.room.memory_mb}MB", "temp_directory": ""})
        early = {rank[part] for token, k in rank.items() for cut in range(1, len(token)) for part in (token[:cut], token[cut:]) if rank.get(part, -1) > k}
        pair, to = [], []
        for token, k in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b), to.append(k)
        self.merges = pa.table({"pair": pa.array(pair, pa.int64()), "id": pa.array(to, pa.int32()), "early": pa.array([int(k in early) for k in to], pa.int32())})
        self._table("merges", **{c: self.merges[c] for c in ("pair", "id")})
        self._table("vocab", id=pa.array(list(rank.values()), pa.int32()), bytes=pa.array(list(rank), pa.binary()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("_new", pa.table(columns))
        self.con.sql(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _new")
        self.con.unregister("_new")

    def _ask(self, sql: str, name: str, **columns: np.ndarray) -> pa.Table:
        self.con.register(name, pa.table(columns))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def _short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids."""
        sizes, ids = [np.zeros(0, "int64")], [np.zeros(0, "<i4")]
        for begin in range(0, len(raw), self.room.at_once):
            part = raw[begin : begin + self.room.at_once]
            lengths = np.fromiter(map(len, part), dtype="int64", count=len(part))
            first = np.cumsum(lengths) - lengths
            place = (np.repeat(np.arange(len(part), dtype="int64"), lengths) << 23) | (np.arange(lengths.sum()) - np.repeat(first, lengths))
            got = self._ask(CONTRACT, "base", place=place, id=self.byte_ids[np.frombuffer(b"".join(part), dtype="uint8")])
            sizes.append(np.bincount(got["place"].to_numpy() >> 23, minlength=len(part)))
            ids.append(got["id"].to_numpy().astype("<i4"))
        return np.concatenate(sizes), np.concatenate(ids)

    def _long(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each long piece; a query holds ROUNDS rounds at most, the next goes on from its result."""
        alphabet, longest, reach = set(b"".join(raw)), 0, {}
        for token, k in sorted(self.rank.items(), key=lambda x: x[1]):
            if alphabet.issuperset(token):
                reach[k] = longest = max(longest, len(token))
        to = self.merges["id"].to_numpy()
        length = np.fromiter((reach.get(k, 0) for k in range(max(self.rank.values()) + 1)), dtype="int64")[to]
        self._table("long_merges", **{c: self.merges[c].filter(pa.array(length > 0)) for c in ("pair", "id", "early")}, reach=pa.array(length[length > 0], pa.int64()))
        lengths = np.array([len(x) for x in raw])
        first = np.cumsum(lengths + 2 * longest + 1) - (lengths + 2 * longest + 1)
        place = np.concatenate([np.arange(n, dtype="int64") + start for n, start in zip(lengths, first, strict=True)])
        ids, merged = self.byte_ids[np.frombuffer(b"".join(raw), dtype="uint8")], 1
        self.con.sql(f"SET memory_limit = '{max(self.room.memory_mb, len(ids) * LONG_BYTES >> 20)}MB'")
        while merged:
            got = self._ask(CONTRACT_LONG.format(rounds=ROUNDS, longest=longest), "base", place=place, id=ids)
            place, ids, merged = got["place"].to_numpy(), got["id"].to_numpy(), got["merged"][0].as_py()
        self.con.sql("DROP TABLE long_merges")
        self.con.sql(f"SET memory_limit = '{self.room.memory_mb}MB'")
        return np.split(ids.astype("<i4"), np.searchsorted(place, first[1:]))

    def contracted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids."""
        long = np.fromiter((len(x) >= LONG for x in raw), dtype=bool, count=len(raw))
        sizes, ids = self._short([x for x, far in zip(raw, long, strict=True) if not far])
        if not long.any():
            return sizes, ids
        far, apart, begin, size = [raw[k] for k in np.flatnonzero(long)], [], 0, 0
        for end, piece in enumerate(far, 1):
            size += len(piece)
            if size >= LONG_AT_ONCE or end == len(far):
                apart.extend(self._long(far[begin:end]))
                begin, size = end, 0
        every = np.zeros(len(raw), "int64")
        every[~long], every[long] = sizes, [len(x) for x in apart]
        starts = np.zeros(len(raw), "int64")
        starts[~long], starts[long] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum([0, *map(len, apart[:-1])])
        return every, gathered(np.concatenate([ids, *apart]), starts, every)

    def learn(self, words: list[str]) -> None:
        """Number pieces that the younger generation lacks, with their ids; a piece that is a token itself needs no merge."""
        base = len(self.young.sizes)
        self.young.number.update(zip(words, range(base, base + len(words)), strict=True))
        raw = [word.encode() for word in words]
        old = np.fromiter((self.old.number.get(word, -1) for word in words), dtype="int64", count=len(words))
        whole = np.fromiter((self.rank.get(x, -1) for x in raw), dtype="int64", count=len(raw))
        known, hard = (whole < 0) & (old >= 0), (whole < 0) & (old < 0)
        sizes, ids = self.contracted([raw[k] for k in np.flatnonzero(hard)])
        every, starts = np.ones(len(words), "int64"), np.zeros(len(words), "int64")
        every[known], starts[known] = self.old.sizes[old[known]], self.old.starts()[old[known]]
        every[hard], starts[hard] = sizes, len(self.old.ids) + np.cumsum(sizes) - sizes
        starts[whole >= 0] = len(self.old.ids) + len(ids) + np.arange((whole >= 0).sum())
        self.young.add(every, gathered(np.concatenate([self.old.ids, ids, whole[whole >= 0].astype("<i4")]), starts, every))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has.

        Texts are cut into chunks first, since equal chunks have equal pieces: before single spaces where the pattern
        allows it, else a text is one chunk.
        """
        if len(self.young.number) >= self.room.generation:
            self.old, self.young = self.young, Generation()
        spaced, apart, codes, counts = Numbered(), Numbered(), [], []
        for text in texts:  # numbers of chunks after a space, and below zero of the others
            if self.spaced and not self.uncut(text):
                first, *rest = text.split(" ")
                code = np.empty(len(rest) + 1, "int64")
                code[1:] = np.fromiter(map(spaced.__getitem__, rest), dtype="int64", count=len(rest))
                code[0] = ~apart[first]
            else:
                code = np.array([~apart[text]], dtype="int64")
            codes.append(code), counts.append(len(code))
        # Chunks after a space make up a text whose pieces end where they do.
        found = self.pieces("".join([" " + word for word in spaced]))
        ends = np.cumsum(np.fromiter(map(len, found), dtype="int64", count=len(found)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, spaced), dtype="int64", count=len(spaced)) + 1), "right")
        held = np.diff(last, prepend=0).tolist()
        for key in apart:
            more = self.pieces(key)
            found.extend(more), held.append(len(more))
        pieces = Numbered()
        of_chunk = np.fromiter(map(pieces.__getitem__, found), dtype="int64", count=len(found))
        after = len(spaced)
        del found, spaced, apart
        words = list(pieces)
        del pieces
        self.learn([word for word in words if word not in self.young.number])
        number = np.fromiter(map(self.young.number.__getitem__, words), dtype="int64", count=len(words))
        for word in words:
            if len(word) >= LONG:  # long pieces are rarely met again
                del self.young.number[word]
        # Pieces to chunks to texts, by their runs of ids.
        sizes, starts = self.young.sizes[number], self.young.starts()[number]
        ids = gathered(self.young.ids, starts[of_chunk], sizes[of_chunk])
        ends, last = np.concatenate([[0], np.cumsum(sizes[of_chunk])]), np.cumsum(held, dtype="int64")
        chunk_start, chunk_end = ends[last - held], ends[last]
        code = np.concatenate([np.zeros(0, "int64"), *codes])
        code = np.where(code < 0, after + ~code, code)
        lengths = (chunk_end - chunk_start)[code]
        total, last = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(counts, dtype="int64")
        return gathered(ids, chunk_start[code], lengths), total[last] - total[last - np.array(counts, dtype="int64")]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [b""] * len(lengths)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(lengths):
            base = ends[begin] - lengths[begin]
            end = max(begin + 1, int(np.searchsorted(ends, base + self.room.tokens_at_once, "right")))
            part = ids[base : ends[end - 1]]
            got = self._ask(DECODE, "tokens", d=np.repeat(np.arange(begin, end, dtype="int32"), lengths[begin:end]), p=np.arange(len(part), dtype="int32"), id=part)
            parts = got["parts"].combine_chunks()
            flat = parts.flatten()  # the bytes of neighbours lie side by side
            cuts = np.frombuffer(flat.buffers()[1], dtype="int32")[flat.offset : flat.offset + len(flat) + 1]
            text = flat.buffers()[2].to_pybytes() if len(flat) else b""
            at = cuts[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
            for d, low, high in zip(got["d"].to_pylist(), at[:-1], at[1:], strict=True):
                out[d] = text[low:high]
            begin = end
        return out


_coders: dict[tuple[int, str, Room], Coder] = {}


def coder(ranks: bytes, pattern: str, room: Room = Room()) -> Coder:
    """The worker's coder of a vocabulary, made once."""
    key = (hash(ranks), pattern, room)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern, room)
    return _coders[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", room: Room = Room()) -> DataFrame:
    """(id_col, ids array<int>, decoded binary) of every row.

    Whole texts are encoded, each match of ``pattern`` separately, without special tokens. A null text counts as
    empty; an empty text has no ids and decodes to no bytes. Repeated rows and repeated or null ids give a row
    each; other columns of ``docs`` are ignored, whatever their names. An empty table gives an empty table. The
    rank file (bounded by the vocabulary) is read on the driver and broadcast. A worker's memory grows with its
    longest piece, by LONG_BYTES bytes for each byte of it; the rest is bounded by ``room``, which changes no result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks.value, pattern, room)
        for batch in text_slices(batches, most=room.text_at_once):
            ids, lengths = c.encode([text or "" for text in batch.column(1).to_pylist()])
            decoded = c.decode(ids, lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    source = need(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the result of encode_decode()."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
