"""Licence scans: an Aho-Corasick automaton over words, and licence expressions.

Each text is reduced to its words (see ``blocks``) with single blanks between
them; the automaton then finds whole-word notice phrases and the words of an
identifier tag in one pass.  The expression after a tag is read from the original
text: a shunting-yard pass turns ``A OR (B AND C WITH D)`` into postfix form,
which is evaluated to the set of licences named and the strictest duty that the
best choice leaves.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WORD_BYTES

#: phrase -> label: the phrases counted in n_base.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
OWN_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by 4 0": "cc-by-4.0",
    "creative commons": "cc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "licensed under the apache": "apache",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "artistic license": "artistic",
    "free documentation license": "gfdl",
    "open font license": "ofl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "business source license": "busl",
    "server side public license": "sspl",
    "elastic license": "elastic",
    "open database license": "odbl",
    "proprietary and confidential": "proprietary",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How strict an identifier is, by prefix: 0 free use, 1 keep notices, 2 weak and 3 strong copyleft, 4 restricted.
DUTY_OF_PREFIX = {
    "cc0": 0, "unlicense": 0, "0bsd": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "cc-by-4": 1, "cc-by-3": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "gpl": 3, "agpl": 3, "cc-by-sa": 3, "cc-by-nc": 4, "cc-by-nd": 4,
}
UNKNOWN_DUTY = 4
_LINE = re.compile(rb"(?i)spdx-license-identifier\s*:\s*([^\r\n*/<>\"']*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard; None if the expression is malformed.  Ends before words that can't follow."""
    out, ops, operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            ops.append(token)
        elif token == ")":
            if operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in _RANK:
            if operand:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            if not operand:
                break  # prose after the expression
            out.append(token.rstrip(".") if token.endswith(".") else token)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def duty_of(licence: str) -> int:
    low = licence.lower()
    found = max((p for p in DUTY_OF_PREFIX if low.startswith(p)), key=len, default=None)
    return UNKNOWN_DUTY if found is None else DUTY_OF_PREFIX[found]


def evaluate(expression: str) -> tuple[list[str], int] | None:
    """(licences named, duty left by the best choice): and takes the stricter, or the freer side."""
    rpn = postfix(expression)
    if rpn is None:
        return None
    stack: list[tuple[frozenset, int]] = []
    for token in rpn:
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            if token == "with":  # an exception only adds permissions
                stack.append((a[0], min(a[1], 2) if a[1] == 3 else a[1]))
            else:
                stack.append((a[0] | b[0], (max if token == "and" else min)(a[1], b[1])))
        else:
            stack.append((frozenset([token.lower()]), duty_of(token)))
    return (sorted(stack[0][0]), stack[0][1]) if len(stack) == 1 else None


def build_automaton(base: dict, own: dict):
    automaton = ahocorasick.Automaton()
    for phrase, (label, is_base) in {**{p: (v, False) for p, v in own.items()}, **{p: (v, True) for p, v in base.items()}}.items():
        words = phrase.split(" ")
        automaton.add_word(f" {phrase} ", (len(f" {phrase} "), len(words), label, is_base))
    automaton.add_word(f" {TAG} ", (len(f" {TAG} "), 3, None, False))
    automaton.make_automaton()
    return automaton


def scan_text(data: bytes, automaton) -> dict:
    """What one text (UTF-8) holds."""
    words = data.translate(WORD_BYTES).split()
    # latin-1: one character a byte, so phrases (ASCII) and places agree
    line = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last, base_labels, labels, tagged, spots = 0, None, None, set(), set(), False, []
    for end, (length, _, label, is_base) in automaton.iter(line):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        start = end - length + 1
        spots.append(start)
        if is_base:
            n_base += 1
            base_labels.add(label)
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
    expressions, duty = [], None
    if tagged:
        for found in _LINE.finditer(data):
            text = found[1].decode("utf-8", "replace").strip()
            value = evaluate(text)
            if value:
                expressions.append(text)
                labels.update(value[0])
                duty = value[1] if duty is None else max(duty, value[1])
    # each kind of evidence leaves half (phrase) or a tenth (tag) of the doubt
    score = 1.0 - 0.5 ** len(labels) * (0.1 if expressions else 1.0) if labels else 0.0
    return {
        "n_words": len(words), "n_base": n_base,
        "first_word": None if first is None else line.count(" ", 0, first),
        "last_word": None if last is None else line.count(" ", 0, last),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
        "score": score, "expressions": expressions, "duty": duty,
    }


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>, duty int")
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("expressions", pa.list_(pa.string())), ("duty", pa.int32())])


def scan_licences(docs: DataFrame, base: dict = BASE_PHRASES, own: dict = OWN_PHRASES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, duty) of every row.

    A null text is an empty one: no words, no labels, score 0.  Labels are
    distinct, sorted and comma-joined.  Places that overlap all count.  Repeated
    rows give repeated results; no shuffle.  Texts are scanned whole, in blocks of about
    four megabytes, a longer one alone; an empty table gives no rows.  Columns other than
    the id and the text play no part, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = build_automaton(base, own)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_string()).cast(pa.large_binary())
            for lo in range(0, batch.num_rows, 512):
                rows = [scan_text(t.as_py(), automaton) for t in texts.slice(lo, 512)]
                columns = [batch.column(0).slice(lo, 512)] + [pa.array([r[f.name] for r in rows], f.type) for f in _ARROW]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *_ARROW.names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
