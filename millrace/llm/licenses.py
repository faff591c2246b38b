"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, blob, named, plain_words

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Other notices: normalised words and label.
NOTICES = {
    "permission is hereby granted free of charge": "mit", "released under the mit license": "mit", "mit licensed": "mit", "licensed under the apache license": "apache-2", "apache 2 0 license": "apache-2",
    "gnu general public license version 3": "gpl-3", "gnu general public license v3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu general public license v2": "gpl-2", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause", "under the bsd license": "bsd", "under the isc license": "isc",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution 4 0": "cc-by", "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain", "in the public domain": "public-domain", "this is free and unencumbered software": "unlicense", "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: Expression identifiers, lower-cased, by label; a trailing -only, -or-later or + is dropped first. Others stay as they are.
IDENTIFIERS = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "mpl-2.0": "mpl", "epl-2.0": "epl", "cc0-1.0": "cc0"} | {f"cc-{k}-{v}": f"cc-{k}" for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "3.0", "4.0")}
#: How freely text under a licence may be used, from 0 to 1; unknown ones count as 0.3.
PERMISSION = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "gpl-2": 0.5, "gpl-3": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.1, "all-rights-reserved": 0.0}
STRENGTH = {"base": 0.9, "notice": 0.8, "tag": 0.99}
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Of one line. What follows a tag is read only as far as an expression goes.
TOKEN = re.compile(rb"[^\S\n]*([()]|[A-Za-z0-9.+:-]*[A-Za-z0-9+])")
ASSIGN = re.compile(rb"[^\S\n]*[:=]")
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def label_of(identifier: str) -> str:
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return IDENTIFIERS.get(x, x)


def tokens(text: bytes | str, at: int = 0) -> Iterator[str]:
    """The words and brackets that follow in a line."""
    text = text.encode() if isinstance(text, str) else text
    while m := TOKEN.match(text, at):
        word = m[1].decode()
        yield word.upper() if word.upper() in PRECEDENCE else word
        at = m.end()


def postfix(words: Iterable[str]) -> list[str]:
    """Shunting yard: the longest valid expression that the words begin with, in postfix order; [] if there is none. No more words are taken than that needs."""
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] = (0, [])  # so much of out, and the operators that end it
    operand = True  # an operand must follow
    depth = 0
    for w in words:
        if w == "(" and operand:
            stack.append(w)
            depth += 1
        elif w == ")" and not operand and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif w in PRECEDENCE and not operand:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[w]:
                out.append(stack.pop())
            stack.append(w)
            operand = True
        elif w not in PRECEDENCE and w not in "()" and operand:
            out.append(w)
            operand = False
        else:
            break
        if not operand and not depth:
            best = len(out), stack[::-1]
    return out[: best[0]] + best[1]


def exceptions(expression: list[str]) -> list[str]:
    """What stands after `with` in a postfix expression, sorted."""
    return sorted({b for b, w in pairwise(expression) if w == "WITH"})


def evaluate(expression: list[str]) -> tuple[set[str], float | None]:
    """Labels and permission of a postfix expression: `or` may choose the freer side, `and` is bound by both, `with` adds an exception to its left side."""
    stack: list[tuple[set[str], float]] = []
    for w in expression:
        if w in PRECEDENCE:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if w != "WITH":
                if len(a) < len(b):
                    a, b = b, a
                a |= b
                x = max(x, y) if w == "OR" else min(x, y)
            stack.append((a, x))
        else:
            k = label_of(w)
            stack.append(({k}, PERMISSION.get(k, 0.3)))
    return stack[0] if stack else (set(), None)


def automaton() -> ahocorasick.Automaton:
    out, values = ahocorasick.Automaton(), {}
    for phrase, value in [(k, ("notice", v)) for k, v in NOTICES.items()] + [(k, ("tag", "")) for k in TAGS] + [(k, ("base", v)) for k, v in BASE.items()]:
        values.setdefault(phrase, []).append(value)
    for phrase, found in values.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, found))
    out.make_automaton()
    return out


def scan(matcher: ahocorasick.Automaton, text: bytes | None) -> dict:
    """All that op7 returns of one text, and the expressions with their permission."""
    words = plain_words(text)
    out: dict = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "permission": None, "expressions": [], "exceptions": []}
    found = list(matcher.iter(" " + b" ".join(words).decode("latin-1") + " ")) if words else []
    if not found:
        return out
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    at = np.searchsorted(starts, [end - n + 1 for end, (n, _, _) in found]).tolist()
    base, labels, places, permissions, doubt = set(), set(), [], [], 1.0
    spans = None
    for first, (_, (_, n, values)) in zip(at, found, strict=True):
        for kind, label in values:
            if kind == "tag":
                spans = spans or [m.span() for m in WORD.finditer(text)]
                assign = ASSIGN.match(text, spans[first + n - 1][1])
                expression = postfix(tokens(text, assign.end())) if assign else []
                names, permission = evaluate(expression)
                if not names:
                    continue
                out["expressions"].append(" ".join(expression))
                out["exceptions"] += exceptions(expression)
                permissions.append(permission)
                labels |= names
            else:
                labels.add(label)
                permissions.append(PERMISSION.get(label, 0.3))
                if kind == "base":
                    base.add(label)
                    places.append(first)
            doubt *= 1 - STRENGTH[kind]
    if places:
        out |= {"n_base": len(places), "first_word": min(places), "last_word": max(places)}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - doubt, "permission": min(permissions) if permissions else None}


def licensed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: counts and places of base phrases, labels, score (how surely a licence is stated), permission (the least
    of all that is stated), parsed expressions in postfix order and the exceptions that they name after `with`. Identifiers that no table knows are labels
    as they stand. Null and empty texts have no words and score 0; repeated rows give a row each; an empty table gives an empty result; other columns
    are ignored."""
    matcher = documents.sparkSession.sparkContext.broadcast(automaton())

    def run(batch: dict[str, list]) -> dict[str, list]:
        rows = [scan(matcher.value, t) for t in batch["text"]]
        return {"id": batch["id"]} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permission", "expressions", "exceptions")}

    schema = f"id {dict(documents.dtypes)[id_col]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permission double, expressions array<string>, exceptions array<string>"
    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), schema, run).withColumnRenamed("id", id_col)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return licensed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
