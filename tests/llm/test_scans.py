"""Licences, personal data and secrets against plain readings of their definitions."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from weftlink.llm import licenses, pii, secrets

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def license_row(text):
    w = re.findall(WORD, lower(text))
    at = sorted((i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))


def test_licenses(docs, rows, edges):
    for df, of in ((docs, rows), (edges, None)):
        got = licenses.digests(licenses.scan(df)).collect()
        of = of or {r["doc_id"]: r["text"] for r in edges.collect()}
        assert len(got) == df.count()
        for r in got:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_row(of[r["doc_id"]])
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(edges.limit(0)).count() == 0


def test_license_templates(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3. All Rights Reserved",
        "Permission is hereby granted, free of charge, to ANY persons obtaining a copy of this software and associated documentation files", "Licensed under CC BY-NC 4.0", "the apache version of a license", "CC\u212aBY cc-by CC by",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.digests(licenses.scan(df)).collect()}
    assert got == {0: ("apache-2.0", 0), 1: ("mit", 0), 2: ("gpl,gpl-3.0,reserved", 2), 3: ("mit", 0), 4: ("cc-by,cc-by-nc", 1), 5: ("", 0), 6: ("cc-by", 2)}


def base_pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) < 256 for p in m.split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits(m))))) % 10 == 0,
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if good[k](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab1@.-_ ", max_size=25), st.text("0123456789 -.+()", max_size=40), st.text("12.+5 ", max_size=30)))
def test_base_pii(text):
    assert pii.base_spans(text) == base_pii(text)


def test_pii(docs, rows, edges):
    for df, of in ((docs, rows), (edges, {r["doc_id"]: r["text"] for r in edges.collect()})):
        got = pii.digests(pii.find(df)).collect()
        assert len(got) == df.count()
        for r in got:
            want = base_pii(of[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}
    assert pii.find(edges.limit(0)).count() == 0 and pii.redact(edges.limit(0)).count() == 0


def test_pii_votes(spark):
    rows = [(i, f"please call my phone ({200 + i}) 555-0{100 + i} or mail joe{i} (at) mail (dot) com, iban DE89 3704 0044 0532 0130 00") for i in range(30)]
    rows += [(100 + i, f"invoice 123-{10 + i % 80}-4567 version 1.2.{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert {s["kind"] for s in spans[0]} == {"phone_local", "email_obfuscated", "iban"}
    assert not any(spans[100 + i] for i in range(30))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[0] == "please call my phone <PHONE_LOCAL> or mail <EMAIL_OBFUSCATED>, iban <IBAN>" and red[100] == rows[30][1]


def base_secrets(t):
    t = t or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(docs, rows, edges):
    for df, of in ((docs, rows), (edges, {r["doc_id"]: r["text"] for r in edges.collect()})):
        got = secrets.digests(secrets.scan(df)).collect()
        assert len(got) == df.count()
        for r in got:
            want = base_secrets(of[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert secrets.scan(edges.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ("db_pwd = 'Xk29fjQ0zz81'", ["Xk29fjQ0zz81"]),
        ("base = 'Xk29fjQ0zz81'\nconfig.clientSecret = base", ["Xk29fjQ0zz81"]),
        ("color = 'Xk29fjQ0zz81'", []),
        ("password_hint: 'blue house number 7'", []),
        ("db_pwd = 'changeme'", []),
        ("In prose: the token of honour.", []),
        ("the key: understanding that it's late, don't worry", []),
        ("cfg['pwd'] = 'Xk29fjQ0zz81'", ["Xk29fjQ0zz81"]),
        ('os.environ["DB_PWD"] = "Xk29fjQ0zz81"', ["Xk29fjQ0zz81"]),
        ("<db_pwd>Xk29fjQ0zz81</db_pwd>", ["Xk29fjQ0zz81"]),
        ("client_secret_pwd = '''Xk29fjQ0zz81'''", ["Xk29fjQ0zz81"]),
        ("db_pwd: |\n  Xk29fjQ0zz81\n  Qq81mmZ0rT44\nother: Xk29fjQ0zz83", ["Xk29fjQ0zz81", "Qq81mmZ0rT44"]),
        ('base = "Xk29fjQ0zz81"\nurl_pwd = "${base}"', ["Xk29fjQ0zz81"]),
        ("BASE=Xk29fjQ0zz81\nDB_PWD=$BASE", ["Xk29fjQ0zz81"]),
        ("pwd = later\nlater = 'Xk29fjQ0zz81'", ["Xk29fjQ0zz81"]),
        ("a = 'Xk29fj'\nb = 'Q0zz81'\npwd = a + b", ["Xk29fj", "Q0zz81"]),
        ("pwd: str = 'Xk29fjQ0zz81'", ["Xk29fjQ0zz81"]),
        ('pwd = f"{base}"\nbase = "Xk29fjQ0zz81"', ["Xk29fjQ0zz81"]),
        ("pwd = ('Xk29fj'\n  'Q0zz81')", ["Xk29fj", "Q0zz81"]),
        ("x = 'Xk29fjQ0zz81'\nx = 'other Xk29fjQ0zz82'\npwd = x", []),
        ("pwd = a\na = b\nb = a", []),
        ("pwd = getpass('Xk29fjQ0zz81')", []),
        ('pwd = "unterminated', []),
        ("pwd = '''", []),
    ],
)
def test_lexer(text, literals):
    assert [text[a:b] for k, a, b, _ in secrets.spans_of(text, 0.6) if k == "literal"] == literals


@settings(max_examples=300, deadline=None)
@given(st.text("toke=: 'AKIA0f", max_size=60))
def test_secret_kinds(text):
    assert [s[:3] for s in secrets.spans_of(text, 0.6) if s[0] != "literal"] == base_secrets(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.one_of(st.integers(0, 4), st.integers(10, 14)), min_size=1, max_size=3)), min_size=1, max_size=7))
def test_propagation(program):
    """Assignments of constants and concatenations: a name has its last assignment before a use, else the first after."""
    name = lambda k: "pwd" if k == 0 else f"v{k}"
    literal = lambda line, k: f"Xk{line}9{k}fjQ0zz"
    lines = [f"{name(target)} = " + " + ".join(name(p) if p < 10 else f"'{literal(n, p)}'" for p in parts) for n, (target, parts) in enumerate(program)]

    def value(n, seen):
        out = []
        for p in program[n][1]:
            if p >= 10:
                out.append(literal(n, p))
            elif p not in seen:
                given_ = [k for k, (target, _) in enumerate(program) if target == p]
                before = [k for k in given_ if k < n]
                if given_:
                    out += value(before[-1] if before else given_[0], seen | {p})
        return out

    want = {x for n, (target, _) in enumerate(program) if target == 0 for x in value(n, {0})}
    text = "\n".join(lines)
    assert {text[a:b] for k, a, b, _ in secrets.spans_of(text, 0.6) if k == "literal"} == want
