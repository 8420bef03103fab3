"""Language identification by prediction by partial matching.

Per language, context trees over lower-cased UTF-8 bytes up to order 3 are counted on a bounded labelled sample and
then frozen. The code length of a byte follows the longest context that the language knows; where the context has
not seen the byte, the escape probability q/(n+q) is paid (n occurrences of the context, q different successors)
and the next shorter context is asked, down to 8 bits for any byte. The language of the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftlink.llm.common import need, text_slices

ORDER = 3
#: What stands before each text.
PAD = b"\n" * ORDER
#: Positions that are scored at once.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Labels that a model may have; characters of whole texts that it is fitted on, in all and for a label at most.
LABELS, FIT_CHARS, LABEL_CHARS = 1000, 32 << 20, 1 << 20


def keys_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it as a number, and where each text starts."""
    raw = np.frombuffer(b"".join([x for t in texts for x in (PAD[:order], t)]), dtype="uint8").astype("uint32")
    n = len(raw) - order
    key = np.zeros(max(n, 0), dtype="uint32")
    for k in range(order + 1):
        key |= raw[k : n + k] << np.uint32(8 * (order - k))
    lengths = np.fromiter(map(len, texts), dtype="int64", count=len(texts))
    starts = np.cumsum(lengths + order) - (lengths + order)
    inside = np.ones(len(key), dtype=bool)  # the pads of later texts are no positions
    for k in range(order):
        at = starts[1:] - order + k
        inside[at[(at >= 0) & (at < len(key))]] = False
    return key[inside], np.cumsum(lengths) - lengths


@dataclass
class Tree:
    """Counts of one language: by order the grams (context and byte) and contexts, as sorted keys."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]

    @classmethod
    def fit(cls, texts: list[bytes]) -> Tree:
        key, _ = keys_of(texts)
        out = cls([], [], [], [], [])
        for order in range(ORDER + 1):
            gram = key if order == ORDER else key & np.uint32((1 << 8 * (order + 1)) - 1)
            grams, counts = np.unique(gram, return_counts=True)
            contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
            out.grams.append(grams), out.counts.append(counts), out.contexts.append(contexts)
            out.totals.append(np.add.reduceat(counts, first) if len(first) else counts)
            out.kinds.append(np.diff(np.append(first, len(grams))))
        return out

    def bits(self, key: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each key after the bytes before it."""
        out = np.zeros(len(key))
        left = np.arange(len(key))
        for order in range(ORDER, -1, -1):
            gram = key[left] if order == ORDER else key[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            if not len(self.grams[order]):
                continue
            c = np.minimum(np.searchsorted(self.contexts[order], gram >> np.uint32(8)), len(self.contexts[order]) - 1)
            known = self.contexts[order][c] == gram >> np.uint32(8)
            space = (self.totals[order] + self.kinds[order])[c]
            g = np.minimum(np.searchsorted(self.grams[order], gram), len(self.grams[order]) - 1)
            hit = self.grams[order][g] == gram
            out[left] += np.where(hit, np.log2(space / self.counts[order][g]), np.where(known, np.log2(space / self.kinds[order][c]), 0.0))
            left = left[~hit]
        out[left] += 8.0
        return out


class Model:
    """The frozen trees of all languages, with the code lengths of all grams that any of them knows."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.langs = sorted(samples)
        self.trees = [Tree.fit(samples[k]) for k in self.langs]
        self.known = np.unique(np.concatenate([t.grams[ORDER] for t in self.trees])) if self.langs else np.zeros(0, "uint32")
        self.table = self._bits(self.known)

    def _bits(self, key: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(key) for t in self.trees], axis=1) if self.trees else np.zeros((len(key), 0))

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        key, starts = keys_of(texts)
        ends = np.append(starts[1:], len(key))
        for low in range(0, len(key), BLOCK):
            part = key[low : low + BLOCK]
            unique, inverse = np.unique(part, return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            rows = self.table[at]
            new = self.known[at] != unique
            rows[new] = self._bits(unique[new])
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(part), "left")
            docs = [d for d in range(first, last) if ends[d] > starts[d]]
            if docs:
                cuts = [max(0, int(starts[d]) - low) for d in docs]
                for k in range(len(self.langs)):
                    out[docs, k] += np.add.reduceat(rows[:, k][inverse], cuts)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a byte) of each text. The score is the language's share of the posterior under equal priors; ties go to the first name."""
        out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
        which = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        raw = [texts[i].lower().encode() for i in which]
        for i, t, bits in zip(which, raw, self.totals(raw) if raw else [], strict=True):
            best = int(np.argmin(bits))
            out[i] = (self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), float(bits[best] / len(t)))
        return out


def labelled_sample(docs: DataFrame, rows: int, id_col: str, text_col: str, label_col: str, fit_chars: int = FIT_CHARS, label_chars: int = LABEL_CHARS) -> dict[str, list[bytes]]:
    """Whole texts of each language, from rows whose crc32 of the id isn't divisible by 5: in the order of a hash, at most ``rows``, until they hold ``label_chars`` characters, or an equal part of ``fit_chars`` where labels are many."""
    docs = need(docs, id_col, text_col, label_col)
    of_id = F.col(f"`{id_col}`").cast("string")
    text = F.col(f"`{text_col}`")
    fit = docs.filter((F.crc32(of_id) % 5 != 0) & F.col(f"`{label_col}`").isNotNull() & (F.length(text) > 0))
    fit = fit.withColumn("_label", F.col(f"`{label_col}`").cast("string"))
    counts = fit.groupBy("_label").count().limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    if not counts:
        return {}
    # Hashes below a label's threshold leave about twice as many rows as are taken, however many there are.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["_label"], min(1.0, 2.0 * rows / r["count"] + 20.0 / r["count"]))])
    below = F.pmod(F.xxhash64(of_id), F.lit(1 << 32)) / float(1 << 32) < F.element_at(share, F.col("_label"))
    drawn = fit.filter(below).select(F.col("_label").alias("lang"), F.xxhash64(of_id).alias("h"), text.alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    held = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.withColumns({"rank": F.row_number().over(order), "held": held}).filter((F.col("rank") <= rows) & (F.col("held") < min(label_chars, fit_chars // len(counts))))
    out: dict[str, list[bytes]] = {}
    for r in ranked.select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"].lower().encode())
    return {k: sorted(v) for k, v in out.items()}


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    rows: int = 400, samples: dict[str, list[bytes]] | None = None, keep: tuple[str, ...] = (), with_text: bool = False,
) -> DataFrame:
    """(id_col, keep..., [text_col,] lang_pred, score, bits) of every row; bits: of the best language, a byte.

    Fitted on at most ``rows`` whole texts of about LABEL_CHARS characters for each label (see labelled_sample), or on
    ``samples``; every whole text is scored. A null text and one without a letter give ``und``, score 0 and null bits, as does
    every text where no row is labelled. Repeated rows give a row each; columns other than ``keep`` are ignored;
    an empty table gives an empty table.
    """
    model = Model(labelled_sample(docs, rows, id_col, text_col, label_col) if samples is None else samples)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = need(docs, id_col, *keep, text_col)
    last = len(source.columns) - 1
    stay = last + with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, last):
            found = shared.value.predict(batch.column(last).to_pylist())
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(stay)), *columns], names=[*(f"c{i}" for i in range(stay)), "lang_pred", "score", "bits"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema[:stay]))
    out = source.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double")
    return out.toDF(*source.columns[:stay], *out.columns[stay:])


def held_out(df: DataFrame, id_col: str = "doc_id"):
    """Whether a row was kept from the fit: crc32 of its id as text is divisible by 5; a null id never is."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
