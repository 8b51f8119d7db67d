"""Licence scan: Aho-Corasick over tags and notice phrases, a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from biblio_spark.llm.bytescan import chunks, normalised

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notices, label and weight of evidence, matched on whole words.
NOTICES = {
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "eclipse public license": ("epl", 0.8),
    "isc license": ("isc", 0.8),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("proprietary", 0.6),
}
BASE_WEIGHT = 0.8
TAG_WEIGHT = 0.95

#: Words that announce an expression: ``SPDX-License-Identifier: <expression>``.
TAG = "spdx license identifier"

OPERATORS = {"or": 1, "and": 2, "with": 3}

OUTPUT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "expressions array<string>, permissive boolean, score double"
)


#: Forms of licence identifiers and of exceptions, in lower case.
IDENTIFIER = re.compile(
    r"""(?:(?:gpl|lgpl|agpl|gfdl)-[1-3]\.[0-9](?:-only|-or-later)?|apache-[12]\.[01]|bsd-[1-4]-clause(?:-[a-z]+)*|0bsd|mit(?:-0|-cmu)?|
    mpl-[12]\.[01](?:-no-copyleft-exception)?|epl-[12]\.0|cddl-1\.[01]|cpl-1\.0|eupl-1\.[0-2]|osl-[1-3]\.[01]|artistic-[12]\.0(?:-perl)?|bsl-1\.0|ecl-[12]\.0|
    cc-by(?:-nc)?(?:-nd|-sa)?-[1-4]\.[05]|cc0-1\.0|ofl-1\.[01]|lppl-1\.[0-3][ac]?|isc|zlib|unlicense|wtfpl|x11|ncsa|postgresql|python-2\.0|psf-2\.0|php-3\.0[01]?|
    ruby|curl|openssl|libpng|libtiff|ijg|ftl|vim|w3c|icu|hpnd|bzip2-1\.0\.[56]|upl-1\.0|unicode-dfs-201[56]|licenseref-[a-z0-9.-]+)\+?""",
    re.VERBOSE,
)
EXCEPTION = re.compile(r"[a-z0-9.-]+-exception(?:-[a-z0-9.-]+)?|linux-syscall-note|u-boot-exception-2\.0")

#: Words that announce the licences of a text, names of licences and of exceptions as they follow, longest first.
ANNOUNCED = ("licensed under", "released under", "distributed under", "available under")
NAMES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "gnu general public license": "gpl", "apache license": "apache",
    "apache software license": "apache", "mozilla public license": "mpl", "eclipse public license": "epl", "mit license": "mit", "bsd license": "bsd", "isc license": "isc",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by": "cc-by", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl",
    "mit": "mit", "apache": "apache", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc",
    "classpath exception": "classpath-exception-2.0", "linking exception": "classpath-exception-2.0", "runtime library exception": "gcc-exception-3.1",
}
_NAMES = sorted(((tuple(k.split()), v) for k, v in NAMES.items()), key=lambda x: -len(x[0]))
FILLERS = ("the", "terms", "of", "either", "a", "both", "license", "licenses", "its")
#: Words that a name with its version and what follows it may take.
AHEAD = 12


def tokenize_expression(text: str) -> list[str]:
    """The longest run of tokens from the start of ``text`` that can be an expression of known identifiers; it ends with the line.
    After ``with`` an exception must stand."""
    line = text.split("\n", 1)[0].replace("(", " ( ").replace(")", " ) ").replace("*/", " ").replace("-->", " ")
    tokens: list[str] = []
    operand = True  # what may come next
    depth = 0
    for raw in line.split():
        token = raw.strip("\"'`,;").rstrip(".").lower()
        if token == "(" and operand and tokens[-1:] != ["with"]:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif token in OPERATORS and not operand:
            operand = True
        elif operand and (EXCEPTION if tokens[-1:] == ["with"] else IDENTIFIER).fullmatch(token):
            operand = False
        else:
            break
        tokens.append(token)
    while tokens and (tokens[-1] in OPERATORS or tokens[-1] == "("):
        tokens.pop()
    return tokens


def tokenize_notice(words: list[str]) -> list[str]:
    """The same from the words after an announcement: names of licences with their versions, parted by operators."""
    return _notice(words)[0]


def announced(words: str, at: int) -> list[str]:
    """The tokens of the notice that begins at a place in the words of a text, however long it is: more words are taken until the notice
    ends before them."""
    size = 1000
    while True:
        whole = at + size >= len(words)
        part = words[at : at + size].split()
        tokens, used = _notice(part if whole else part[:-1])
        if whole or used + AHEAD < len(part):
            return tokens
        size *= 4


def _notice(words: list[str]) -> tuple[list[str], int]:
    """(tokens, number of words that were read)."""
    tokens: list[str] = []
    at, operand = 0, True
    while at < len(words):
        name = next((x for x in _NAMES if tuple(words[at : at + len(x[0])]) == x[0]), None) if operand else None
        if name and ("exception" in name[1]) == (tokens[-1:] == ["with"]):
            at += len(name[0])
            token = name[1]
            after = at + 1 if words[at : at + 1] == ["version"] else at
            number = re.fullmatch(r"v?([0-9])", words[after]) if after < len(words) else None
            if number and "exception" not in token:
                minor = words[after + 1] if re.fullmatch("[0-9]", (words[after + 1 : after + 2] or [""])[0]) else "0"
                token = f"{token}-{number[1]}.{minor}"
                at = after + (2 if words[after + 1 : after + 2] == [minor] else 1)
                if words[at : at + 2] == ["or", "later"] or words[at : at + 4] == ["or", "any", "later", "version"]:
                    at += 2 if words[at + 1] == "later" else 4
                    token += "-or-later"
            tokens.append(token)
            operand = False
        elif words[at] in OPERATORS and not operand:
            tokens.append(words[at])
            operand, at = True, at + 1
        elif words[at] in FILLERS:
            at += 1
        else:
            break
    while tokens and tokens[-1] in OPERATORS:
        tokens.pop()
    return tokens, at


def parse_expression(tokens: list[str]) -> list[str]:
    """Shunting-yard: the expression in reverse Polish order; an unfinished tail is left out."""
    output: list[str] = []
    stack: list[str] = []
    for token in tokens:
        if token in OPERATORS:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[token]:
                output.append(stack.pop())
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if stack:
                stack.pop()
        else:
            output.append(token)
    while stack:
        top = stack.pop()
        if top != "(":
            output.append(top)
    return output


#: First parts of identifiers of permissive licences.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "0bsd")


def evaluate_expression(postfix: list[str]) -> tuple[set[str], bool] | None:
    """(licence identifiers, may it be used under permissive terms): ``or`` needs one side, ``and`` both, ``with``
    keeps the licence of its left side and adds the exception to its name."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in OPERATORS:
            stack.append(({token}, token.startswith(PERMISSIVE)))
            continue
        if len(stack) < 2:
            continue
        (right, free_right), (left, free_left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{x} with {y}" for x in left for y in right}, free_left))
        elif token == "or":
            stack.append((left | right, free_left or free_right))
        else:
            stack.append((left | right, free_left and free_right))
    return stack[-1] if stack else None


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    phrases = [(p, ("base", label, BASE_WEIGHT)) for p, label in BASE_PHRASES.items()]
    phrases += [(p, ("notice", label, weight)) for p, (label, weight) in NOTICES.items()]
    phrases.append((TAG, ("tag", "", TAG_WEIGHT)))
    phrases += [(p, ("announced", "", TAG_WEIGHT)) for p in ANNOUNCED]
    for phrase, value in phrases:
        machine.add_word(f" {phrase} ", (len(phrase) + 1, *value))
    machine.make_automaton()
    return machine


def scan_text(machine, text: str, words: str) -> tuple:
    """The row of OUTPUT after n_words. ``words``: the text as lower-case words with one space before, between and
    after; ``text``: as it is, for the expressions after tags."""
    places, base, labels, expressions = [], set(), set(), []
    permissive, rest = None, 1.0
    tagged, parsed = False, []
    for end, (length, kind, label, weight) in machine.iter(words):
        if kind == "base":
            places.append(end - length)
            base.add(label)
            labels.add(label)
            rest *= 1 - weight
        elif kind == "notice":
            labels.add(label)
            rest *= 1 - weight
        elif kind == "announced":
            parsed.append(announced(words, end))
        else:
            tagged = True
    if tagged:
        lowered, at = text.lower(), 0
        while (at := lowered.find("spdx-license-identifier", at)) >= 0:
            at += len("spdx-license-identifier")
            line = lowered.find("\n", at)
            after = lowered[at : line if line >= 0 else len(lowered)].lstrip(" \t")
            if after.startswith(":"):
                parsed.append(tokenize_expression(after[1:]))
    for tokens in parsed:
        postfix = parse_expression(tokens)
        if found := evaluate_expression(postfix):
            labels |= found[0]
            permissive = found[1] if permissive is None else permissive and found[1]
            expressions.append(" ".join(postfix))
            rest *= 1 - TAG_WEIGHT
    span = (None, None)
    if places:
        spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), dtype="<u4") == 0x20)
        span = tuple(np.searchsorted(spaces, [min(places), max(places)]).tolist())
    return len(places), *span, sorted(base), sorted(labels), expressions, permissive, 1.0 - rest


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and OUTPUT.

    n_words counts the lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; n_base counts all places where a base
    phrase stands as consecutive words; first_word and last_word are the least and greatest of their starts, in
    words from 0, null without any. ``labels`` holds those of base phrases, of further notices and the licences in
    expressions, which follow an SPDX tag (known identifiers and exceptions only) or words like "licensed under" (names with
    their versions); ``permissive`` is the value of all expressions together, null without one. ``score`` is 1 minus the
    product of (1 - weight) over all evidence, so 0 without any. A null text is empty, repeated rows give repeated results,
    an empty table an empty one, other columns of ``docs`` are left aside. Row by row: no shuffle, texts of any length whole.
    """
    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in batches:
            for first, end, data, offsets in chunks(batch, "text"):
                out, bounds, words = normalised(data, offsets)
                rows = []
                for k in range(end - first):
                    lowered = out[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")
                    raw = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") if TAG in lowered else ""
                    rows.append((int(words[k + 1] - words[k]), *scan_text(machine, raw, lowered)))
                columns = list(zip(*rows, strict=True))
                arrays = [batch.column("id").slice(first, end - first)]
                arrays += [pa.array(list(c), type=t) for c, t in zip(columns, TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *COLUMNS])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {id_type}, {OUTPUT}").withColumnRenamed("id", id_column)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "permissive", "score"]
TYPES = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.bool_(), pa.float64()]
