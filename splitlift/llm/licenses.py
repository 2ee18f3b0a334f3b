"""Licence scan: phrases and identifier tags by Aho-Corasick, expressions by a
shunting-yard parser.

A text's words are its runs of ASCII letters (lower-cased), digits and non-ASCII
characters; everything else separates them. One automaton over the words, joined
by single blanks, finds the notice phrases and the words of the identifier tag at
all their places, overlapping ones too. After a tag, the text of the same line is
parsed as a licence expression: the longest beginning that is one counts. ``with``
binds tightest, then ``and``, then ``or``; brackets group. Identifiers that are not
in ``FAMILIES`` end the expression.

Every licence has a weight (0 to 1, how much it restricts). ``and`` takes the heavier
side, ``or`` the lighter one (the reader may choose), ``with`` lightens by a
quarter. A document's score is its heaviest phrase or expression, 0 without any.

Defined cases: NULL text is empty; texts without words have 0 words, no places and
empty label lists; a tag without a valid expression adds nothing; repeated rows and
NULL ids each give their own row; only the two named columns are read. A text is
scanned whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Phrases of this operator's own.
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Identifiers of expressions by their first characters, longest match first.
FAMILIES = {
    "0bsd": "bsd", "agpl-": "agpl", "apache-2": "apache-2", "bsd-": "bsd", "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by-": "cc-by", "cc0-": "cc0", "gpl-2": "gpl-2",
    "gpl-3": "gpl-3", "isc": "isc", "lgpl-": "lgpl", "licenseref-": "proprietary", "mit": "mit", "mpl-2": "mpl-2",
    "unlicense": "unlicense", "zlib": "zlib",
}
WEIGHTS = {
    "cc0": 0.1, "unlicense": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "apache-2": 0.2, "cc-by": 0.2,
    "mpl-2": 0.4, "lgpl": 0.4, "cc-by-sa": 0.6, "gpl-2": 0.8, "gpl-3": 0.8, "agpl": 0.9, "cc-by-nd": 0.9,
    "cc-by-nc": 1.0, "proprietary": 1.0,
}
LIGHTER = 0.75
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9.+-]+)")
_WORD = re.compile(rb"[^ ]+")
# Letters to lower case, digits and bytes of non-ASCII characters kept, the rest blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))


def family(name: str) -> str | None:
    """The label of an expression's identifier, None if it is not a known licence."""
    fits = [p for p in FAMILIES if name == p or name.startswith(p) and (p[-1] in "-" or name[len(p)] in "-.+")]
    return FAMILIES[max(fits, key=len)] if fits else None


def expression_tokens(raw: bytes) -> list[str]:
    """Tokens of the longest beginning of ``raw`` that is a whole expression."""
    tokens: list[str] = []
    whole = depth = at = 0
    operand = True  # what is expected next
    while m := _TOKEN.match(raw, at):
        token, at = m[1].decode(), m.end()
        if operand:
            excepted = bool(tokens) and tokens[-1] == "with"
            if token == "(" and not excepted:
                depth += 1
            elif token[0] not in "()" and token not in PRECEDENCE and (excepted or family(token.rstrip("."))):
                operand = False
            else:
                break
        elif token == ")" and depth:
            depth -= 1
        elif token in PRECEDENCE and (token != "with" or tokens[-1] != ")" and tokens[-2:-1] != ["with"]):
            operand = True
        else:
            break
        tokens.append(token)
        if not operand and not depth:
            whole = len(tokens)
    return tokens[:whole]


def evaluate(tokens: list[str]) -> tuple[frozenset[str], float]:
    """Labels and weight of an expression, by two stacks: operators wait until one
    that binds no tighter, or a closing bracket, arrives."""
    values: list[tuple[frozenset[str], float]] = []
    waiting: list[str] = []

    def reduce() -> None:
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            values.append((left[0], left[1] * LIGHTER))
        else:
            values.append((left[0] | right[0], (max if op == "and" else min)(left[1], right[1])))
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                reduce()
            waiting.append(token)
        else:
            label = family(token.rstrip("."))
            values.append((frozenset([label] if label else []), WEIGHTS.get(label, 0.0)))
    while waiting:
        reduce()
    return values[0]


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*phrases, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: bytes, automaton: ahocorasick.Automaton, phrases: dict[str, str], base: dict[str, str]
              ) -> tuple[int, list[dict], list[dict]]:
    """Words of a text, places of its phrases and its expressions."""
    spaced = text.translate(_WORDS)
    words = spaced.split()
    # One character per byte: the phrases are ASCII, and no decoding can fail.
    line = f" {b' '.join(words).decode('latin-1')} "
    spans, tags = [], []
    seen = blanks = 0
    for end, phrase in automaton.iter(line):
        start = end - len(phrase) - 1
        if start < seen:
            blanks -= line.count(" ", start, seen)
        else:
            blanks += line.count(" ", seen, start)
        seen = start
        if phrase == TAG:
            tags.append(blanks)
        else:
            spans.append({"start": blanks, "label": phrases[phrase], "base": phrase in base,
                          "weight": WEIGHTS[phrases[phrase]]})
    return len(words), spans, list(tag_expressions(text, spaced, tags))


def tag_expressions(text: bytes, spaced: bytes, tags: list[int]) -> Iterator[dict]:
    """Expressions behind the tags that start at these words (ascending), on their lines."""
    words = enumerate(_WORD.finditer(spaced))
    for start in tags:
        at = next(m.end() for k, m in words if k == start + TAG.count(" "))
        stop = text.find(b"\n", at)
        rest = text[at:stop if stop >= 0 else len(text)]
        tokens = expression_tokens(rest.lstrip(b" \t:=").lower())
        if tokens:
            labels, weight = evaluate(tokens)
            yield {"start": start, "expression": " ".join(tokens), "labels": sorted(labels), "weight": weight}


SPANS = "array<struct<start: long, label: string, base: boolean, weight: double>>"
EXPRESSIONS = "array<struct<start: long, expression: string, labels: array<string>, weight: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("base", pa.bool_()),
                             ("weight", pa.float64())]))
_EXPRESSIONS = pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()),
                                   ("labels", pa.list_(pa.string())), ("weight", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  more: dict[str, str] = MORE_PHRASES) -> DataFrame:
    """One row per document: id, n_words, ``spans`` (phrases found: start in words,
    label, base or not, weight), ``expressions`` (tags: start, tokens, labels, weight)."""
    phrases = {**BASE_PHRASES, **more}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)
        for batch in batches:
            found = [scan_text(t.as_py(), automaton, phrases, BASE_PHRASES) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], _SPANS), pa.array([f[2] for f in found], _EXPRESSIONS)],
                names=["id", "n_words", "spans", "expressions"])
    return (rows.mapInArrow(run, f"id {id_type}, n_words long, spans {SPANS}, expressions {EXPRESSIONS}")
            .withColumnRenamed("id", id_col))


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last base word, label lists and score of each document."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat(F.transform("spans", lambda s: s["label"]),
                     F.flatten(F.transform("expressions", lambda e: e["labels"])))
    weights = F.concat(F.transform("spans", lambda s: s["weight"]), F.transform("expressions", lambda e: e["weight"]))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda s: s["label"])).alias("base_labels"), joined(every).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("expressions").cast("long").alias("n_expressions"))
