"""License scans: Aho-Corasick over words, shunting-yard over licence expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that must be reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases, with the licence each names.
NOTICES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "boost software license": "bsl-1.0",
    "eclipse public license": "epl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "business source license": "busl",
    "common development and distribution license": "cddl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons zero": "cc0",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "microsoft public license": "ms-pl",
    "open database license": "odbl",
    "open software license": "osl",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "the software is provided as is without warranty of any kind": "mit",
    "university of illinois ncsa open source license": "ncsa",
    "zlib license": "zlib",
    "no rights reserved": "cc0",
    "some rights reserved": "cc-by",
    "confidential and proprietary": "proprietary",
    "proprietary and confidential": "proprietary",
    "unauthorized copying": "proprietary",
}
TAG = "spdx license identifier"
# How freely a work may be used under a licence, by the start of its identifier.
FREEDOM = {
    "afl": 0.9, "agpl": 0.2, "apache": 1.0, "artistic": 0.7, "bsd": 1.0, "bsl": 1.0, "busl": 0.1, "cddl": 0.6, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc-by": 0.9, "cc0": 1.0, "epl": 0.6,
    "eupl": 0.5, "gfdl": 0.3, "gpl": 0.3, "isc": 1.0, "lgpl": 0.5, "mit": 1.0, "mpl": 0.6, "ms-pl": 0.8, "ncsa": 1.0, "odbl": 0.5, "ofl": 0.8, "osl": 0.4,
    "proprietary": 0.0, "psf": 1.0, "public-domain": 1.0, "reserved": 0.0, "sspl": 0.2, "unlicense": 1.0, "zlib": 1.0,
}
UNKNOWN_FREEDOM = 0.4
#: Every byte that isn't part of a word becomes a space; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TAGGED = re.compile(r"spdx[^a-z0-9\x80-\U0010ffff]+license[^a-z0-9\x80-\U0010ffff]+identifier[ \t]*:?", re.IGNORECASE)
TOKEN = re.compile(r"[()\n]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
OPERATORS = {"or": 1, "and": 2, "with": 3}


def freedom(licence: str) -> float:
    return next((FREEDOM[k] for k in sorted(FREEDOM, key=len, reverse=True) if licence.startswith(k)), UNKNOWN_FREEDOM)


def postfix(text: str, at: int = 0) -> list[str]:
    """Shunting-yard: the longest well-formed expression that starts at ``at``, operands and operators in postfix order.

    Reading stops at the end of the line, unless a bracket is open, and where two
    operands meet without an operator, so prose that follows a tag is left alone; a
    dangling operator is dropped.
    """
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    for m in TOKEN.finditer(text, at):
        token = m[0]
        word = token.lower().rstrip(".:")
        if token == "\n":
            if "(" not in stack:
                break
        elif token == "(":
            if not want_operand:
                break
            stack.append(token)
        elif token == ")":
            if want_operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in OPERATORS:
            if want_operand:
                break
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[word]:
                out.append(stack.pop())
            stack.append(word)
            want_operand = True
        else:
            if not want_operand:
                break
            out.append(word)
            want_operand = False
    if want_operand and stack and stack[-1] in OPERATORS:
        stack.pop()
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(expression: list[str]) -> tuple[set[str], float | None]:
    """The licences that an expression in postfix order names and its freedom: ``or`` takes the better side,
    ``and`` the worse, ``with`` eases its licence by an exception."""
    names: set[str] = set()
    stack: list[tuple[str, float]] = []
    for token in expression:
        if token not in OPERATORS:
            stack.append((token, freedom(token)))
        elif len(stack) > 1:
            (_, b), (name, a) = stack.pop(), stack.pop()
            if token == "with":
                names.add(name)
                stack.append(("", min(1.0, a + 0.1)))
            else:
                names.update(x for x in (name, _) if x)
                stack.append(("", max(a, b) if token == "or" else min(a, b)))
    names.update(x for x, _ in stack if x)
    return names, stack[-1][1] if stack else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    joined = b" ".join(text.translate(WORD_BYTES).split())
    n_words = joined.count(b" ") + 1 if joined else 0
    base, more, tagged = [], set(), False
    for end, phrase in machine.iter(f" {joined.decode('utf-8', 'replace')} "):
        if phrase in BASE:
            base.append((end, phrase))
        elif phrase == TAG:
            tagged = True
        else:
            more.add(NOTICES[phrase])
    labels = {BASE[p] for _, p in base}
    free, expressions = None, []
    if tagged:
        raw = text.decode("utf-8", "replace")
        for m in TAGGED.finditer(raw):
            expression = postfix(raw, m.end())
            names, value = evaluate(expression)
            if value is not None:
                more |= names
                free = value if free is None else min(free, value)
                expressions.append(" ".join(expression))
    first = last = None
    if base:
        padded = f" {joined.decode('utf-8', 'replace')} "
        starts = [end - len(phrase) - 1 for end, phrase in base]
        first, last = padded.count(" ", 0, min(starts)), padded.count(" ", 0, max(starts))
    if free is None and labels | more:
        free = min(freedom(x) for x in labels | more)
    evidence = 0.6 * len(base) + 0.8 * len(more)
    return (n_words, len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1 - math.exp(-evidence), free, "; ".join(expressions))


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64()), ("expressions", pa.string())]


def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        columns = list(zip(*(scan(t.as_py(), machine) for t in batch.column("text")), strict=True)) or [()] * len(FIELDS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], names=["doc_id", *(n for n, _ in FIELDS)])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence evidence in each text of ``docs`` (doc_id, text), one row a row.

    n_words, and n_base, first_word, last_word, base_labels for the phrases of
    BASE; labels adds NOTICES and the licences in tagged expressions. score grows
    from 0 (no evidence) towards 1; freedom (0 to 1, null without evidence) is the
    tagged expressions' value, the strictest if several, else the strictest
    notice's; expressions holds them in postfix. A null or empty text has no words,
    empty labels, null places and score 0; repeated rows give a row each; an empty
    table gives an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(scans, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, expressions string")
