"""License scans: an automaton finds tags and phrases, a shunting-yard parser reads licence expressions."""

from __future__ import annotations

import re
from typing import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows, texts

# ---- Fixed values: phrases with the labels they stand for ----------------------------------------
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "cc0": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
FAMILIES = ("apache", "mit", "bsd", "mpl", "lgpl", "agpl", "gpl", "epl", "isc", "zlib", "unlicense", "cc0", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by")
OPEN = {"apache", "mit", "bsd", "mpl", "lgpl", "agpl", "gpl", "epl", "isc", "zlib", "unlicense", "public-domain", "cc-by", "cc-by-sa"}
RANK = {"or": 1, "and": 2, "with": 3}

SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in SEPARATORS else c for c in range(256)
)
TAG_PLACE = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]+)", re.I)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")


# ---- Expressions ---------------------------------------------------------------------------------


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: ``with`` binds closest, then ``and``, then ``or``. None: not an expression."""
    out, stack, operand_next = [], [], True
    for t in tokens:
        op = t.lower()
        if op in RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            stack.append(t)
        elif t == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """All licence labels of an expression, and whether it can be met with open licences only.

    ``or``: one side suffices; ``and``: both are needed; ``with``: an exception leaves the licence as it is.
    """
    stack: list[tuple[set[str], bool]] = []
    for t in postfix:
        if t == "with":
            stack.pop()
        elif t in RANK:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            stack.append((a | b, free_a or free_b if t == "or" else free_a and free_b))
        else:
            label = family(t)
            stack.append(({label}, label in OPEN))
    return stack[0]


def family(identifier: str) -> str:
    low = identifier.lower()
    found = next((f for f in FAMILIES if low == f or low.startswith((f + "-", f + "+"))), None)
    return {"cc0": "public-domain", None: "other"}.get(found, found)


def leading_expression(text: str) -> list[str] | None:
    """Postfix form of the longest expression at the start of a tag's value; what follows it is prose."""
    tokens, end, depth, operand_next = [], 0, 0, True
    for m in TOKEN.finditer(text):
        t = m.group()
        if t.lower() in RANK or t == "(":
            depth += t == "("
            operand_next = True
        elif t == ")":
            depth -= 1
        elif operand_next:
            operand_next = False
        else:
            break
        tokens.append(t)
        if not operand_next and depth == 0:
            end = len(tokens)
    return to_postfix(tokens[:end])


# ---- Texts ---------------------------------------------------------------------------------------


def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks: they match whole words only."""
    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, *TAGS}:
        a.add_word(f" {phrase} ", (phrase, len(phrase.split())))
    a.make_automaton()
    return a


def scan_text(text: str, phrases: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, open_terms of one text."""
    words = text.encode().translate(TO_WORDS).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode()} "
    base, found, tagged = [], {}, False
    at, count = 0, 0  # blanks seen up to a place: the number of the word that starts after it
    for end, (phrase, n) in phrases.iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE_PHRASES:
            if start >= at:
                count += line.count(" ", at, start)
                at, word = start, count
            else:
                word = count - line.count(" ", start, at)
            base.append((word, BASE_PHRASES[phrase]))
        if phrase in TAGS:
            tagged = True
        elif phrase in NOTICE_PHRASES:
            found[NOTICE_PHRASES[phrase]] = 0.8
    open_terms = None
    for value in TAG_PLACE.findall(text) if tagged else ():
        postfix = leading_expression(value)
        if postfix:
            labels, free = evaluate(postfix)
            found |= dict.fromkeys(labels, 1.0)
            open_terms = free if open_terms is None else open_terms and free
    base_labels = {label for _, label in base}
    found = dict.fromkeys(base_labels, 0.7) | found
    # Independent signs add up; none: 0.
    doubt = 1.0
    for label in sorted(found):
        doubt *= 1 - found[label]
    starts = [w for w, _ in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(found)),
        1 - doubt,
        open_terms,
    )


def scan(docs: DataFrame) -> DataFrame:
    """Licence signs of every row; a null or empty text has no words, no labels and score 0.

    ``open_terms``: whether all tagged expressions can be met with open licences; null without a tag.
    """

    def rows(batches: Iterator[dict]):
        phrases = automaton()
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                yield i, *scan_text(t, phrases)

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, open_terms boolean"
    )
    return map_rows(texts(docs), rows, schema)
