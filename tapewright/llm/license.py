"""Licence scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

One pass of an Aho-Corasick automaton over the words of a text (ASCII lower case, joined by single spaces) finds the
base phrases and the further notice phrases. Identifier tags are found by the same automaton over the lower-cased
text; the expression after a tag is parsed with AND / OR / WITH precedences (WITH binds closest, then AND, then OR) and
gives the labels it names. An expression ends with its line. The parsed expressions are then evaluated by whole identifiers (families serve as labels only):
terms is the most demanding of a text's expressions, of permissive, linking (copyleft with an exception for works that link to it) and other, and
permissive whether it is permissive (null: no expression).

Null text counts as empty: no words, no labels, score 0. Repeated rows keep one result each; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.common import slices, utf8_rows

#: The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Further notice phrases, as their normalised words, and their labels.
NOTICE_PHRASES = {
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Tags after which a licence expression follows, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifier prefixes and the label of their family, longest first.
FAMILIES = (
    ("unlicense", "unlicense"),
    ("apache", "apache"),
    ("cc-by", "cc-by"),
    ("agpl", "agpl"),
    ("lgpl", "lgpl"),
    ("bsd", "bsd"),
    ("bsl", "bsl"),
    ("cc0", "cc0"),
    ("epl", "epl"),
    ("gpl", "gpl"),
    ("isc", "isc"),
    ("mit", "mit"),
    ("mpl", "mpl"),
)
#: Whole identifiers, in lower case, of licences whose terms are permissive. Any other identifier is not.
PERMISSIVE = frozenset(
    """0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-2.0 beerware blueoak-1.0.0
    bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-2-clause-views bsd-3-clause bsd-3-clause-attribution bsd-3-clause-clear bsd-3-clause-lbnl
    bsd-3-clause-modification bsd-3-clause-open-mpi bsd-4-clause bsd-4-clause-uc bsd-source-code bsl-1.0 bzip2-1.0.6
    cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 curl ecl-2.0 fsfap fsful fsfullr ftl hpnd icu ijg intel isc libpng libpng-2.0
    mit mit-0 mit-advertising mit-cmu mit-feh mit-modern-variant ms-pl mulanpsl-1.0 mulanpsl-2.0 naist-2003 ncsa nist-pd ntp openssl pddl-1.0 php-3.0 php-3.01
    postgresql psf-2.0 python-2.0 sgi-b-2.0 smlnj spencer-94 tcl unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 unlicense upl-1.0 w3c w3c-20150513
    wtfpl x11 xnet zlib zlib-acknowledgement zpl-2.0 zpl-2.1""".split()
)
#: Exceptions that allow use with works under other terms.
LINKING = frozenset(("autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-3.1", "llvm-exception"))

#: Terms of expressions, from the least demanding.
TERMS = ("permissive", "linking", "other")

#: Every byte that no word holds becomes a space, A-Z become a-z; bytes of 128 and over stay.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: What may follow a prefix: nothing, a version or a further part.
_REST = re.compile(r"v?\d|[-.+]|$")
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")


def parse_expression(tokens: list[str]) -> tuple | None:
    """Shunting-yard: a nested (operator, left, right) tuple or an identifier; None where tokens are no expression."""
    out: list = []
    ops: list[str] = []

    def reduce() -> bool:
        if len(out) < 2:
            return False
        right, left = out.pop(), out.pop()
        out.append((ops.pop(), left, right))
        return True

    operand = True  # what must come next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                if not reduce():
                    return None
            if not ops:
                return None
            ops.pop()
        elif t in _PRECEDENCE:
            if operand:
                return None
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[t]:
                if not reduce():
                    return None
            ops.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    while ops:
        if ops[-1] == "(" or not reduce():
            return None
    return out[0] if len(out) == 1 and not operand else None


def satisfied(tree: tuple | str, allowed: frozenset[str] | set[str] = PERMISSIVE) -> bool:
    """Whether an expression can be met with the allowed identifiers: OR by either side, AND by both, WITH by its licence.

    A licence or any later version (+) counts as that version.
    """
    if isinstance(tree, str):
        return tree in allowed or tree.endswith("+") and tree[:-1] in allowed
    op, left, right = tree
    if op == "with":
        return satisfied(left, allowed)
    return (any if op == "or" else all)(satisfied(x, allowed) for x in (left, right))


def linkable(tree: tuple | str) -> bool:
    """Whether an expression can be met by permissive licences and ones with a linking exception."""
    if isinstance(tree, str):
        return satisfied(tree)
    op, left, right = tree
    if op == "with":
        return satisfied(left) or right in LINKING
    return (any if op == "or" else all)(linkable(x) for x in (left, right))


def terms(tree: tuple | str) -> str:
    return "permissive" if satisfied(tree) else "linking" if linkable(tree) else "other"


def family(identifier: str) -> str:
    """The label of an identifier: its family's, or itself where it has none."""
    return next((label for prefix, label in FAMILIES if identifier.startswith(prefix) and _REST.match(identifier, len(prefix))), identifier.rstrip("+"))


def identifiers(tree: tuple | str) -> list[str]:
    """The licences an expression names, without the exceptions of WITH."""
    if isinstance(tree, str):
        return [tree]
    op, left, right = tree
    return identifiers(left) if op == "with" else identifiers(left) + identifiers(right)


def _automaton(keys: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, v in keys.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def expression_after(text: bytes, at: int) -> tuple[str, tuple | str | None]:
    """The expression that starts at byte at of a lower-cased text: as far as its tokens parse on one line."""
    tokens: list[str] = []
    operand, depth, end = True, 0, at
    while m := _TOKEN.match(text, end):
        t = m[1].decode("ascii")
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t in _PRECEDENCE and not operand:
            operand = True
        elif t not in _PRECEDENCE and t not in "()" and operand:
            operand = False
        else:
            break
        tokens.append(t)
        end = m.end()
    while tokens and (tokens[-1] in _PRECEDENCE or tokens[-1] == "("):
        tokens.pop()
    return " ".join(tokens), parse_expression(tokens) if tokens else None


class Scanner:
    """Finds licence evidence in one text at a time; built once per task."""

    def __init__(self) -> None:
        marks: dict[str, object] = {}
        for phrase, label in BASE_PHRASES.items():
            marks[f" {phrase} "] = (len(phrase), label, True)
        for phrase, label in NOTICE_PHRASES.items():
            marks[f" {phrase} "] = (len(phrase), label, False)
        self.phrases = _automaton(marks)
        self.tags = _automaton({t: len(t) for t in TAGS})

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        starts: np.ndarray | None = None  # of the words, once there is a hit
        base: list[tuple[int, str]] = []
        labels: set[str] = set()
        evidence = 0
        for end, (length, label, is_base) in self.phrases.iter(joined.decode("latin-1")):
            if is_base:
                if starts is None:
                    starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
                base.append((int(np.searchsorted(starts, end - length)), label))  # the phrase's first letter
            else:
                evidence += 1
            labels.add(label)
        expressions, met = [], []
        lower = text.lower()
        for end, _ in self.tags.iter(lower.decode("latin-1")):
            said, tree = expression_after(lower, end + 1)
            if tree is not None:
                expressions.append(said)
                met.append(terms(tree))
                labels.update(family(x) for x in identifiers(tree))
                evidence += 2
        base_labels = {x for _, x in base}
        weight = len(base) + evidence
        return (
            len(words),
            len(base),
            min((p for p, _ in base), default=None),
            max((p for p, _ in base), default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels)),
            weight / (weight + 1.0),
            expressions,
            max(met, key=TERMS.index) if met else None,
            all(x == "permissive" for x in met) if met else None,
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence evidence of each row of docs: counts and places of base phrases, labels, expressions and a score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, terms string, permissive boolean"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "terms", "permissive"]
        for b in slices(batches, "text", 16_000_000):
            rows = [scanner.scan(x) for x in utf8_rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
