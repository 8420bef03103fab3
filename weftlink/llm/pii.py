"""Personal data by weak supervision.

Candidate spans come from broad patterns. Labelers (strict form, checksum or gazetteer, context words, contrary
context, boundaries) vote for, against or not at all. The votes of all documents are counted by pattern, of which
there are boundedly many; expectation-maximisation estimates from the counts how reliable each labeler is and how
likely each pattern is to be personal; a logistic span classifier fitted on these posteriors decides. Spans of the
base kinds are always kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftlink.llm.common import need, text_slices

#: Kinds with fixed definitions, in their order; then those of the method.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_obfuscated", "phone_local", "national_id", "iban")
LABELERS = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?)[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")

#: Top-level domains, country calling codes and lengths of account numbers for the gazetteer.
TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at se no dk fi pl pt ie eu ca au nz jp cn in br mx ar ru za".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421 971 972".split())
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "GB": 22, "IE": 22, "PT": 25, "PL": 28, "SE": 24, "NO": 15, "DK": 18, "FI": 18}
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write|kontakt|correo|courriel|@", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|sms|handy|anruf|llam|appel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|logged|from|client|adresse", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", re.I),
    "national_id": re.compile(r"ssn|social|security|national|insurance|\bid\b", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
}
CONTRARY = re.compile(r"version|release|isbn|issn|order|invoice|serial|build|section|page|figure|\bno\.?$|\bv\.?$|#$|%$|\$$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[local]+@label(.label)+``, in linear time: each @ is tried with all that may stand before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


HAS_DIGIT = re.compile(r"[0-9]")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base spans and what the broad patterns add outside them, by kind, then start."""
    digit = HAS_DIGIT.search(text) is not None
    out = base_spans(text) if digit or "@" in text else []
    more: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(x in low for x in ("(at)", "[at]", "{at}")):
        more += [("email_obfuscated", m.start(), m.end()) for m in OBFUSCATED.finditer(text)]
    if digit:
        for kind, pattern in (("phone_local", LOCAL_PHONE), ("national_id", NATIONAL), ("iban", IBAN)):
            more += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if more:
        out += [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in out)]
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing. Labelers: form, gazetteer or checksum, context, boundaries."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = digits_of(span)
    family = kind.split("_")[0] if kind.startswith(("email", "phone")) else kind
    if family == "email":
        form = 1 if kind == "email" and not span.startswith(".") and ".." not in span else 0
        known = 1 if re.split(r"[.\s)\]}]", span)[-1].lower() in TLDS else -1
    elif kind == "ip":
        form = 1 if all(p == str(int(p)) for p in span.split(".")) else -1
        known = -1 if span.split(".")[0] in ("0", "255") else 1
    elif kind == "card":
        form = 1 if len(digits) in (15, 16) else 0
        known = 1 if digits[0] in "3456" else -1
    elif family == "phone":
        form = 1 if 9 <= len(digits) <= 13 else 0
        known = (1 if any(digits.startswith(c) for c in CALLING) else -1) if kind == "phone" else (-1 if digits[0] in "01" else 0)
    elif kind == "national_id":
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        known = 0
    else:
        solid = span.replace(" ", "")
        known = 1 if IBAN_LENGTH.get(solid[:2]) == len(solid) else -1
        form = 1 if int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1 else -1
    context = 1 if CUES[family].search(before) else -1 if CONTRARY.search(before[-14:].rstrip()) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edge = 1 if not (left.isalnum() or right.isalnum()) else -1
    return (form, known, context, edge)


class Classifier:
    """The reliabilities that EM estimates and the span classifier fitted on its posteriors."""

    def __init__(self, counts: dict[tuple, int], rounds: int = 50) -> None:
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], dtype=float)
        v = np.array([p[1:] for p in patterns], dtype=int).reshape(len(patterns), LABELERS)
        kind = np.array([KINDS.index(p[0]) for p in patterns], dtype=int)
        # q: the posterior that a pattern is personal; it starts from the majority of its votes.
        q = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
        prior = np.full(len(KINDS), 0.5)
        says = np.full((2, LABELERS, 3), 1 / 3)
        for _ in range(rounds if len(patterns) else 0):
            for k in range(len(KINDS)):
                w = n * (kind == k)
                prior[k] = ((w * q).sum() + 1) / (w.sum() + 2)
            for truth, weight in ((1, n * q), (0, n * (1 - q))):
                for j in range(LABELERS):
                    for value in (-1, 0, 1):
                        # A weak prior says that labelers are better than chance.
                        lean = 4.0 if value == (1 if truth else -1) else 1.0
                        says[truth, j, value + 1] = (weight * (v[:, j] == value)).sum() + lean
                    says[truth, j] /= says[truth, j].sum()
            log = np.log(prior[kind]) - np.log1p(-prior[kind])
            for j in range(LABELERS):
                log += np.log(says[1, j, v[:, j] + 1]) - np.log(says[0, j, v[:, j] + 1])
            q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        self.reliability = says
        # The classifier: logistic regression by Newton steps on (kind, votes), weighted by counts.
        x = np.concatenate([np.eye(len(KINDS))[kind], (v > 0), (v < 0)], axis=1).astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(25 if len(patterns) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (q - p)) - w
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            w = w + np.linalg.solve(hess, grad)
        self.weights = w

    def probability(self, kind: str, v: tuple[int, ...]) -> float:
        x = np.concatenate([np.eye(len(KINDS))[KINDS.index(kind)], [a > 0 for a in v], [a < 0 for a in v]])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[tuple, int]:
    """How often each pattern of kind and votes occurs over all texts; at most one row a pattern and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in text_slices(batches, 0):
            for text in batch.column(0).to_pylist():
                for kind, start, end in candidates(text) if text else ():
                    key = (kind, *votes(text, kind, start, end))
                    counts[key] = counts.get(key, 0) + 1
        names = ["kind", *(f"v{j}" for j in range(LABELERS)), "n"]
        columns = list(zip(*[(*k, c) for k, c in counts.items()], strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

    keys = ["kind", *(f"v{j}" for j in range(LABELERS))]
    counted = need(docs, text_col).mapInArrow(run, "kind string, " + "".join(f"v{j} bigint, " for j in range(LABELERS)) + "n bigint")
    bound = len(KINDS) * 3**LABELERS
    rows = counted.groupBy(*keys).agg(F.sum("n").alias("n")).limit(bound).collect()
    return {tuple(r[k] for k in keys): r["n"] for r in rows}


SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, classifier: Classifier | None = None) -> DataFrame:
    """(id_col, spans) of every row: spans of kind, start, stop (code points, stop exclusive) and score, by kind, then start.

    Base kinds are always there, whatever their score; the method's kinds from ``threshold`` on, where they overlap
    no base span. Whole texts are read; a null or empty text has no spans. Repeated rows give a row each and count
    as often; other columns are ignored, whatever their names; an empty table gives an empty table. The classifier
    is fitted on the votes over all of ``docs`` unless one is given.
    """
    judge = Classifier(vote_counts(docs, text_col)) if classifier is None else classifier

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}

        def score(text: str, kind: str, start: int, end: int) -> float:
            key = (kind, v) if (v := votes(text, kind, start, end)) is not None else ()
            if key not in known:
                known[key] = judge.probability(kind, v)
            return known[key]

        for batch in text_slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                scored = [(kind, a, b, score(text, kind, a, b)) for kind, a, b in (candidates(text) if text else ())]
                rows.append([{"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in scored if k in BASE_KINDS or s >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPAN_TYPE)], names=["id", "spans"])

    source = need(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.7, classifier: Classifier | None = None) -> DataFrame:
    """docs with each personal span of the text replaced by its kind in angle brackets; all columns stay, in their order.

    Of overlapping spans the first is replaced, and of those the longest. A null text stays null.
    """
    judge = Classifier(vote_counts(docs, text_col)) if classifier is None else classifier
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            out = []
            for text in batch.column(at).to_pylist():
                spans = [(a, -b, k) for k, a, b in (candidates(text) if text else ()) if k in BASE_KINDS or judge.probability(k, votes(text, k, a, b)) >= threshold]
                parts, last = [], 0
                for a, b, k in sorted(spans):
                    if a >= last:
                        parts += [text[last:a], f"<{k.upper()}>"]
                        last = -b
                out.append("".join([*parts, text[last:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the result of find()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(id_col), *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
