"""Licence scan: Aho-Corasick over notice phrases and identifier tags, licence expressions by shunting-yard."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, by_block

#: The phrases (as words) of the base labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices (as words) and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}

#: Tags (lower case) that a licence expression follows on the same line.
TAGS = ("spdx-license-identifier:", "license-expression:")

#: Licences and exceptions (lower case) that the policy accepts.
ACCEPTED = frozenset({"mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0", "zlib", "llvm-exception"})

TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
LINE_END = re.compile(r"[\n\r]")
OPERATORS = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str]:
    """A licence expression in postfix order: licences in lower case, then the operators ``or and with``.

    Shunting-yard: ``with`` binds a licence to an exception, then ``and``, then ``or``; all to the left, any
    case. Reading stops where no operator follows a complete operand. Raises ValueError if nothing complete
    is read, or if a parenthesis is unmatched.
    """
    output: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand is expected
    for token in TOKEN.findall(expression):
        low = token.lower()
        if operand and token == "(":
            stack.append("(")
        elif operand and low not in OPERATORS and token != ")":
            output.append(low.rstrip(".:"))
            operand = False
        elif not operand and low in OPERATORS:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[low]:
                output.append(stack.pop())
            stack.append(low)
            operand = True
        elif not operand and token == ")" and "(" in stack:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        elif not operand:
            break
        else:
            raise ValueError(expression)
    if operand or "(" in stack:
        raise ValueError(expression)
    return output + stack[::-1]


def longest(expression: str) -> tuple[list[str], bool]:
    """The postfix order of an expression and whether it is complete. Of one that isn't, the longest complete part: it is read up to
    the first token out of place, operators and parentheses that nothing follows go, open parentheses close at its end."""
    try:
        return parse(expression), True
    except ValueError:
        pass
    tokens: list[str] = []
    for token in TOKEN.findall(expression):
        operand = not tokens or tokens[-1] == "(" or tokens[-1].lower() in OPERATORS
        closes = token == ")" and tokens.count("(") > tokens.count(")")
        if (token == ")" or token.lower() in OPERATORS) if operand else not (closes or token.lower() in OPERATORS):
            break
        tokens.append(token)
    while tokens and (tokens[-1] == "(" or tokens[-1].lower() in OPERATORS):
        tokens.pop()
    return parse(" ".join(tokens + [")"] * (tokens.count("(") - tokens.count(")")))) if tokens else [], False


def fold(postfix: list[str], leaf, join):
    """Evaluate a postfix expression: ``leaf(licence)`` and ``join(operator, left, right)``."""
    stack: list = []
    for token in postfix:
        if token in OPERATORS:
            right = stack.pop()
            stack.append(join(token, stack.pop(), right))
        else:
            stack.append(leaf(token))
    return stack[-1]


def licences(postfix: list[str]) -> set[str]:
    """The licences of an expression; one bound to an exception is ``licence with exception``."""
    return fold(postfix, lambda x: {x}, lambda op, a, b: {f"{x} with {y}" for x in a for y in b} if op == "with" and len(a) == len(b) == 1 else a | b)


def allowed(postfix: list[str], accepted: set[str]) -> bool:
    """Whether accepting ``accepted`` licences (and exceptions) meets the expression."""
    return fold(postfix, lambda x: x in accepted, lambda op, a, b: (a or b) if op == "or" else (a and b))


class Scanner:
    """The automata of one task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...], accepted: frozenset[str] = ACCEPTED):
        self.accepted = accepted
        self.words = self._automaton({f" {p} ": (False, p, label) for p, label in notices.items()} | {f" {p} ": (True, p, label) for p, label in base.items()})
        self.tags = self._automaton({t: len(t) for t in tags})

    @staticmethod
    def _automaton(words: dict):
        out = ahocorasick.Automaton()
        for word, value in words.items():
            out.add_word(word, value)
        out.make_automaton()
        return out

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str], int, list[dict]]:
        """(words, starts of base places in order, base labels, all labels, further evidence, expressions)."""
        words = alnum_words(text)
        line = f" {b' '.join(words).decode()} "
        base, labels, starts, more = set(), set(), [], 0
        for end, (is_base, phrase, label) in self.words.iter(line) if len(self.words) else ():
            labels.add(label)
            if is_base:
                base.add(label)
                starts.append(end - len(phrase) - 1)
            else:
                more += 1
        starts.sort()
        at, done, places = 0, 0, []
        for start in starts:
            at, done = at + line.count(" ", done, start), start
            places.append(at)
        raw = text.lower().decode() if len(self.tags) else ""  # bytes.lower is ASCII only
        found = []
        for end, _ in self.tags.iter(raw) if len(self.tags) else ():
            stop = LINE_END.search(raw, end + 1)
            postfix, whole = longest(raw[end + 1 : stop.start() if stop else len(raw)])
            if not postfix:
                continue
            names = licences(postfix)
            labels |= names if whole else set()
            more += 2 if whole else 1
            found.append({"postfix": " ".join(postfix), "licences": sorted(names), "complete": whole, "accepted": allowed(postfix, self.accepted) if whole else None})
        return len(words), places, base, labels, more, found


def scan_licences(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES,
                  tags: tuple[str, ...] = TAGS, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """``docs`` plus ``_n_words``, ``_places`` (word positions where a base phrase's words stand consecutively, in
    order, one for each phrase), ``_base`` and ``_labels`` (sorted distinct labels of the base phrases, and of
    everything found), ``_score`` (1 - 0.5 ** evidence; a place counts 1, a tag's expression 2, an incomplete one 1) and ``_expressions``
    (of each tag, in the text's order: ``postfix``, ``licences``, ``complete``, and ``accepted``, whether accepting the
    licences and exceptions ``accepted`` meets it).

    One pass over whole texts, no shuffle; the phrases go to the tasks with the code. Null texts are empty;
    an expression that is not complete on its line gives its longest complete part to ``_expressions`` (``accepted`` null), but no label; other columns are kept, ones named like the added are replaced.
    """
    old = [c for c in docs.columns if c not in ("_n_words", "_places", "_base", "_labels", "_score", "_expressions")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old)
    made: list[Scanner] = []

    def block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.Table:
        scanner = made[0] if made else made.append(Scanner(base, notices, tags, accepted)) or made[0]
        raw = data.tobytes()
        got = [scanner.scan(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        names = pa.list_(pa.string())
        shape = pa.list_(pa.struct([("postfix", pa.string()), ("licences", names), ("complete", pa.bool_()), ("accepted", pa.bool_())]))
        return pa.table({**{c: rows.column(c) for c in old}, "_n_words": pa.array([g[0] for g in got], pa.int64()),
                         "_places": pa.array([g[1] for g in got], pa.list_(pa.int64())),
                         "_base": pa.array([sorted(g[2]) for g in got], names), "_labels": pa.array([sorted(g[3]) for g in got], names),
                         "_score": pa.array([1 - 0.5 ** (len(g[1]) + g[4]) for g in got], pa.float64()),
                         "_expressions": pa.array([g[5] for g in got], shape)})

    return by_block(docs, schema + ", _n_words long, _places array<long>, _base array<string>, _labels array<string>, _score double, "
                    "_expressions array<struct<postfix:string,licences:array<string>,complete:boolean,accepted:boolean>>", block, text)
