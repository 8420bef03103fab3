"""Secret scans by assignment-aware lexing.

A lexer cuts source and configuration syntax into tokens; a reader of names and values (code, INI and environment
files, YAML with blocks, JSON, XML) turns them into assignments. Constants are propagated through names, concatenation
and interpolation, from the last assignment before a use or else the first after it, and a literal scores by how
sensitive the name is that it reaches. Fixed token patterns are found beside it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftlink.llm.common import need, text_slices

#: Kinds of the fixed patterns, in the order that breaks ties of equal starts; the lexer's own kind comes last.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(
    r"""(?P<newline>\n)|(?P<space>[^\S\n]+)
    |<(?P<tag>[A-Za-z_][\w.:-]*)(?:[^\S\n][^<>\n]*)?>(?P<inner>[^<>\n]+)</(?P=tag)[^\S\n]*>
    |(?P<prefix>\b[fFrRbBuU]{1,2})?(?:\"{3}(?P<double3>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<single3>(?:[^'\\]|\\.|'(?!''))*+)'{3}
        |"(?P<double>(?:[^"\n\\]|\\.)*+)"|'(?P<single>(?:[^'\n\\]|\\.)*+)'|`(?P<back>(?:[^`\\]|\\.)*+)`)
    |(?P<op>:=|=>|={1,3}|[:,;+()\[\]{}<>])
    |(?P<word>[^\s"'`:=,;+()\[\]{}<>]+(?:'\w+)*)
    |(?P<other>.)""",
    re.ASCII | re.DOTALL | re.VERBOSE,
)
QUOTED = ("double3", "single3", "double", "single", "back")
ASSIGNS = frozenset((":=", "=>", "=", "==", "===", ":"))
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*$", re.ASCII)
KEY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\x20-]{0,63}$", re.ASCII)
BARE = re.compile(r"[A-Za-z0-9_$+/.@!%^&*=-]+", re.ASCII)
VARIABLE = re.compile(r"\$(?:\{([A-Za-z_][\w.]*)\}|([A-Za-z_]\w*))", re.ASCII)
BRACED = re.compile(r"\{([A-Za-z_][\w.]*)\}", re.ASCII)
#: Assignments that a literal may pass through on its way to a name.
STEPS = 16
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a part of a name is, and what takes that away.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "private": 0.5, "access": 0.4,
    "api": 0.5, "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.1, "salt": 0.5, "cookie": 0.4, "session": 0.4,
}
SENSITIVE_PART = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)))
HARMLESS = {"name", "file", "path", "url", "uri", "type", "field", "label", "length", "size", "count", "policy", "id", "hint", "public", "expiry", "expires", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|none|null|true|false|undefined|example|password|secret|token|todo|test|your.*|<.*>|\$\{.*\}|%.*%)$")


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target name is, by its parts."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in set(parts)))


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret, by length, entropy and kinds of characters."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 + 0.15 * kinds + max(0.0, entropy - 1.5) / 4) if entropy > 1.5 and not re.search(r"\s", value) else 0.0


class Token(NamedTuple):
    """kind: newline, space, string, element, op, word or other; start and end of the text that counts; name: an element's tag, or a string's prefix."""

    kind: str
    start: int
    end: int
    text: str
    name: str = ""
    close: int = 0


def tokens_of(text: str) -> list[Token]:
    """All tokens but spaces; close: where a token ends, quotes included."""
    out = []
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if m["tag"] is not None:
            out.append(Token("element", *m.span("inner"), m["inner"], m["tag"], m.end()))
        elif kind in QUOTED:
            out.append(Token("string", *m.span(kind), m[kind], (m["prefix"] or "").lower(), m.end()))
        elif kind != "space":
            out.append(Token(kind, *m.span(), m[0], "", m.end()))
    return out


#: A part of a value: a literal's span and text; with a start of -1 the name of a constant; with one below, -2 less the start, a bare word that is a literal unless a constant has that name.
Part = tuple[int, int, str]


def interpolated(token: Token) -> list[Part]:
    """A string as literals and the names within it."""
    pattern, out, at = BRACED if "f" in token.name else VARIABLE, [], 0
    for m in pattern.finditer(token.text):
        if m.start() > at:
            out.append((token.start + at, token.start + m.start(), token.text[at : m.start()]))
        out.append((-1, token.start + m.start(), next(g for g in m.groups() if g is not None)))
        at = m.end()
    if at < len(token.text):
        out.append((token.start + at, token.end, token.text[at:]))
    return out


class Reader:
    """Assignments of a text: (name, where, parts of the value)."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, tokens_of(text)
        self.found: list[tuple[str, int, list[Part]]] = []
        for i, token in enumerate(self.tokens):
            if token.kind == "element":
                self.found.append((token.name, token.start, [(token.start, token.end, token.text)]))
            elif token.kind == "op" and token.text in ASSIGNS and i:
                name = self.target(i - 1)
                if name:
                    parts = self.value(i + 1, token.text == ":")
                    if parts:
                        self.found.append((name, token.start, parts))

    def target(self, i: int) -> str | None:
        """The name that an assignment's left side ends with: a word, a key in quotes, or a subscript."""
        token = self.tokens[i]
        if token.kind == "word":
            m = NAME.search(token.text)
            return m[0] if m else None
        if token.kind == "string" or token.kind == "other" and i and self.tokens[i - 1].kind == "word":
            if token.kind == "other":  # a quote that nothing opened
                return self.target(i - 1) if token.text in "\"'" else None
            return token.text if KEY.match(token.text) else None
        if token.text == "]" and i >= 2 and self.tokens[i - 1].kind == "string" and self.tokens[i - 2].text == "[":
            owner = self.tokens[i - 3] if i >= 3 else None
            m = NAME.search(owner.text) if owner is not None and owner.kind == "word" else None
            return f"{m[0]}.{self.tokens[i - 1].text}" if m else self.tokens[i - 1].text
        return None

    def bare(self, i: int) -> tuple[Token | None, int]:
        """The unquoted value that begins with token i, over operators that stand in it without space, and the token after it."""
        start = self.tokens[i].start
        m = BARE.match(self.text, start)
        if not m:
            return None, i + 1
        while i < len(self.tokens) and self.tokens[i].start < m.end():
            i += 1
        return Token("word", start, m.end(), m[0], "", m.end()), i

    def term(self, i: int) -> tuple[list[Part], int]:
        token = self.tokens[i]
        if token.kind == "string":
            return interpolated(token), i + 1
        if token.kind != "word":
            return [], i
        if token.text == "$" and [t.text for t in self.tokens[i + 1 : i + 4 : 2]] == ["{", "}"]:
            return [(-1, token.start, self.tokens[i + 2].text)], i + 4
        word, after = self.bare(i)
        if word is None:
            return [], after
        follows = self.tokens[after] if after < len(self.tokens) else None
        if follows is not None and follows.start == word.end and follows.text == "[" and after + 2 < len(self.tokens) and self.tokens[after + 1].kind == "string" and self.tokens[after + 2].text == "]":
            return [(-1, word.start, f"{word.text}.{self.tokens[after + 1].text}")], after + 3
        if follows is not None and follows.start == word.end and follows.text in "([":
            return [], after  # a call gives no constant
        if VARIABLE.fullmatch(word.text):
            return [(-1, word.start, word.text[1:])], after
        return [(-2 - word.start, word.end, word.text)], after  # a constant's name if there is one, else a literal

    def value(self, i: int, colon: bool) -> list[Part]:
        tokens, out, inside = self.tokens, [], 0
        if colon and i < len(tokens) and tokens[i].text[:1] in ("|", ">") and (i + 1 == len(tokens) or tokens[i + 1].kind == "newline"):
            return self.block(i)
        while i < len(tokens) and (tokens[i].text == "(" or inside and tokens[i].kind == "newline"):
            inside, i = 1, i + 1
        while i < len(tokens):
            parts, after = self.term(i)
            if not parts:
                break
            if colon and parts[0][0] < -1 and parts[0][2].isalpha():
                parts = [(-1, *parts[0][1:])]  # a plain word after a colon is prose or a constant's name
            out += parts
            i = after
            if colon and len(out) == 1 and out[0][0] < 0 and i < len(tokens) and tokens[i].text == "=":
                return self.value(i + 1, False)  # a type stood between name and value
            j = i
            while inside and j < len(tokens) and tokens[j].kind == "newline":
                j += 1
            if j < len(tokens) and tokens[j].text in ("+", ".", "..", "\\"):
                j += 1
                while j < len(tokens) and tokens[j].kind == "newline":
                    j += 1
                i = j
            elif j < len(tokens) and tokens[j].kind == "string" and parts[-1][0] >= 0 and tokens[i - 1].kind == "string":
                i = j  # neighbouring strings are one
            else:
                break
        return out if len(out) < 2 else [(max(start, -1), end, text) for start, end, text in out]  # bare words of a sum are names

    def block(self, i: int) -> list[Part]:
        """The lines of a YAML block, which are indented deeper than the line of its name."""
        line = self.text.rfind("\n", 0, self.tokens[i].start) + 1
        depth = len(self.text[line:]) - len(self.text[line:].lstrip(" "))
        at, out = self.text.find("\n", self.tokens[i].start) + 1, []
        while 0 < at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            raw = self.text[at:end]
            held = raw.strip()
            if held and len(raw) - len(raw.lstrip(" ")) <= depth:
                break
            if held:
                start = at + raw.index(held)
                out.append((start, start + len(held), held))
            at = end + 1
        return out


def resolved(parts: list[Part], where: int, held: dict[str, list[tuple[int, list[Part]]]], seen: frozenset[str] = frozenset()) -> list[Part]:
    """The literals that a value is made of; a name stands for its last assignment before ``where``, else for the first after it."""
    out: list[Part] = []
    for start, end, text in parts:
        if start >= 0:
            out.append((start, end, text))
            continue
        given = held.get(text)
        if given and text not in seen and len(seen) < STEPS:
            at = bisect_left(given, where, key=lambda x: x[0])
            place, value = given[at - 1] if at else given[0]
            out += resolved(value, place, held, seen | {text})
        elif start < -1 and not given:
            out.append((-2 - start, end, text))
    return out


def lexed(text: str, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name; parts of one value score as the whole of it."""
    assigned = Reader(text).found
    held: dict[str, list[tuple[int, list[Part]]]] = {}
    for name, where, parts in assigned:
        held.setdefault(name, []).append((where, parts))
    found: dict[tuple[int, int], float] = {}
    for name, where, parts in assigned:
        if (names := name_score(name)) > 0:
            literals = resolved(parts, where, held, frozenset((name,)))
            score = math.sqrt(names * literal_score("".join(p[2] for p in literals)))
            for start, end, _ in literals if score >= threshold else ():
                found[start, end] = max(found.get((start, end), 0.0), score)
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def spans_of(text: str, threshold: float) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind; fixed patterns score 1."""
    out: list[tuple[str, int, int, float]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    if SENSITIVE_PART.search(low):
        covered = [(a, b) for _, a, b, _ in out]
        out += [("literal", a, b, s) for a, b, s in lexed(text, threshold) if not any(x <= a and b <= y for x, y in covered)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def span_array(rows: list[list[tuple[str, int, int, float]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "stop", "score"), s, strict=True)) for s in spans] for spans in rows], SPAN_TYPE)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """(id_col, spans) of every row: spans of kind, start, stop (code points, stop exclusive) and score, by start, then kind.

    A span of kind ``literal`` is the method's own and lies in no span of the fixed patterns. Whole texts are read;
    a null or empty text has no spans. Repeated rows give a row each; other columns are ignored, whatever their
    names; an empty table gives an empty table. Equal starts are ordered by kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [spans_of(text, threshold) if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), span_array(found)], names=["id", "spans"])

    source = need(docs, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the result of scan()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col(id_col), *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
