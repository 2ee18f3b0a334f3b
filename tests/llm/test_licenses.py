import itertools
import re

import pytest

from splitlift.llm import licenses as L

from llm_fixtures import make  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_places(text, phrases):
    words = WORD.findall(lower(text))
    out = []
    for phrase, label in phrases.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
    return len(words), sorted(out)


def plain_value(text):
    """Value of a valid expression by recursive descent, a method of its own."""
    tokens = re.findall(r"[()]|[^\s()]+", text.lower())

    def either(at):
        value, at = both(at)
        while at < len(tokens) and tokens[at] == "or":
            right, at = both(at + 1)
            value = value[0] | right[0], min(value[1], right[1])
        return value, at

    def both(at):
        value, at = one(at)
        while at < len(tokens) and tokens[at] == "and":
            right, at = one(at + 1)
            value = value[0] | right[0], max(value[1], right[1])
        return value, at

    def one(at):
        if tokens[at] == "(":
            value, at = either(at + 1)
            return value, at + 1
        label = L.family(tokens[at])
        value = (frozenset([label]), L.WEIGHTS[label])
        if at + 1 < len(tokens) and tokens[at + 1] == "with":
            return (value[0], value[1] * L.LIGHTER), at + 3
        return value, at + 1
    value, end = either(0)
    assert end == len(tokens)
    return value


TEXTS = [
    "", None, "   \n\t", "Released under the MIT License.", "under the mit license under THE (mit) License!",
    "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc by nc-sa, cc-by-nc", "cc by ncx cc by",
    "under the mit\nlicense é under the mit licensé", "apache license version 2 apache license version 2 version 2",
    "This work is licensed under the GNU General Public License, version 3.", "x" * 100_000,
    "word " * 30_000 + "cc by nc " + "word " * 30_000, "SPDX-License-Identifier: MIT", "cc\x00by\x7fnc   cc by nc",
    "İ Kelvin K cc by nc", "cc by nc by nc cc by sa",
]


@pytest.mark.parametrize("more", [L.MORE_PHRASES, {}])
def test_places_match_a_plain_scan(make, more):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in L.scan_licenses(make(rows), more=more).collect()}
    for i, t in rows:
        n, places = plain_places(t or "", {**L.BASE_PHRASES, **more})
        assert got[i].n_words == n
        assert sorted((s.start, s.label) for s in got[i].spans) == places, t


def test_digest(make):
    rows = list(enumerate(TEXTS))
    for r in L.license_digest(L.scan_licenses(make(rows))).collect():
        t = TEXTS[r.doc_id] or ""
        _, base = plain_places(t, L.BASE_PHRASES)
        labels = {x for _, x in plain_places(t, {**L.BASE_PHRASES, **L.MORE_PHRASES})[1]}
        labels |= {"mit"} if "Identifier: MIT" in t else set()
        assert r.n_base == len(base) and r.base_labels == ",".join(sorted({x for _, x in base}))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.labels == ",".join(sorted(labels))
        assert r.score == max([L.WEIGHTS[x] for x in labels], default=0.0)


def expressions(depth):
    ids = ["MIT", "Apache-2.0", "GPL-3.0-only", "CC-BY-NC-4.0", "gpl-2.0+", "MPL-2.0 WITH some-exception"]
    if not depth:
        return ids
    smaller = expressions(depth - 1)
    return ids + [f"{a} {op} {b}" for (a, b), op in zip(itertools.product(smaller[:9], repeat=2),
                                                      itertools.cycle(["AND", "or", "OR", "and"]))] + [
        f"({a})" for a in smaller[-6:]] + [f"({a} or {b}) AND {a}" for a, b in zip(smaller, smaller[3:])]


def test_expressions_match_recursive_descent():
    some = expressions(2)
    assert len(some) > 100
    for e in some:
        tokens = L.expression_tokens(e.lower().encode())
        assert len(tokens) == len(re.findall(r"[()]|[^\s()]+", e)), e
        assert L.evaluate(tokens) == plain_value(e), e


@pytest.mark.parametrize("text, tokens", [
    ("MIT and the rest of the text", "mit"), ("MIT OR", "mit"), ("(MIT OR Apache-2.0", ""), ("banana", ""), ("", ""),
    ("MIT)", "mit"), ("MIT AND (Apache-2.0 or banana)", "mit"), ("MIT Apache-2.0", "mit"), ("with MIT", ""),
    ("GPL-2.0 WITH Classpath-exception-2.0 with x", "gpl-2.0 with classpath-exception-2.0"), ("((MIT))", "( ( mit ) )"),
    ("GPL-2.0-only WITH (MIT)", "gpl-2.0-only"), ("mitten", ""), ("mit-0", "mit-0"), ("() MIT", ""),
])
def test_longest_beginning_that_is_an_expression(text, tokens):
    assert " ".join(L.expression_tokens(text.lower().encode())) == tokens


def test_tags_in_texts(make):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR GPL-3.0) AND\tMPL-2.0\nAND CC-BY-NC-4.0"),
            (2, "spdx license identifier mit. spdx-license-identifier= Apache-2.0 WITH x\nSPDX-License-Identifier: nothing"),
            (3, "SPDX-License-Identifier:"), (4, "é SPDX-License-Identifier: GPL-2.0-or-later\n" * 2000)]
    got = {r.doc_id: r for r in L.scan_licenses(make(rows)).collect()}
    assert [(e.start, e.expression, e.labels, e.weight) for e in got[1].expressions] == [
        (0, "( mit or gpl-3.0 ) and mpl-2.0", ["gpl-3", "mit", "mpl-2"], 0.4)]
    assert [(e.start, e.labels) for e in got[2].expressions] == [(0, ["mit"]), (4, ["apache-2"])]
    assert got[3].expressions == [] and len(got[4].expressions) == 2000
    assert [e.start for e in got[4].expressions[:2]] == [1, 10]  # nine words a line
    digest = {r.doc_id: r for r in L.license_digest(L.scan_licenses(make(rows))).collect()}
    assert (digest[1].labels, digest[1].score) == ("cc-by-nc,gpl-3,mit,mpl-2", 1.0)  # the next line is a phrase
    assert digest[4].score == 0.8 and digest[4].n_base == 0


def test_repeated_rows_nulls_and_empty_table(make):
    rows = [(None, "cc by nc")] * 2 + [(1, "cc by nc"), (2, None)]
    assert sorted(r.n_base for r in L.license_digest(L.scan_licenses(make(rows))).collect()) == [0, 1, 1, 1]
    assert L.license_digest(L.scan_licenses(make([]))).collect() == []
