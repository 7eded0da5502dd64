"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser
evaluates the expressions that follow the tags.

A text is lower-cased in A-Z and cut into words (digits, letters and everything beyond ASCII).
One pass of the automaton over the words joined by single spaces finds every phrase at word
borders. Where it meets the words of a tag, the expression after the tag is parsed from the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: phrase (words) -> label; places of these are counted
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: further notice phrases; they add labels
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl",
}
#: words of identifier tags; the expression stands behind the colon
TAGS = ("spdx license identifier", "license expression")
_TAG_TEXT = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)")
# Licence identifiers of the public SPDX list by family, as patterns of what follows the name
# (an empty one is the bare name); the family is the label.
FAMILIES = {
    "mit": r"|-0|-advertising|-cmu|-enna|-feh|-festival|-modern-variant|-open-group|-wu",
    "apache": r"|-1\.0|-1\.1|-2\.0",
    "gpl": r"|-[123]\.0(?:-only|-or-later|\+|-with-[a-z0-9.-]+-exception)?",
    "lgpl": r"|-(?:2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?",
    "agpl": r"|-[13]\.0(?:-only|-or-later)?",
    "gfdl": r"|-1\.[123](?:-invariants|-no-invariants)?(?:-only|-or-later)?",
    "bsd": r"|-1-clause|-2-clause(?:-freebsd|-netbsd|-patent|-views)?|-3-clause(?:-attribution|-clear|-lbnl|-modification|-no-military-license|-no-nuclear-license|-no-nuclear-license-2014|-no-nuclear-warranty|-open-mpi)?|-4-clause(?:-shortened|-uc)?|-protection|-source-code",
    "0bsd": "",
    "mpl": r"|-1\.0|-1\.1|-2\.0(?:-no-copyleft-exception)?",
    "epl": r"|-1\.0|-2\.0",
    "eupl": r"|-1\.[012]",
    "cddl": r"|-1\.[01]",
    "cpl": r"|-1\.0",
    "ecl": r"|-[12]\.0",
    "efl": r"|-[12]\.0",
    "afl": r"|-1\.1|-1\.2|-2\.0|-2\.1|-3\.0",
    "osl": r"|-1\.0|-1\.1|-2\.0|-2\.1|-3\.0",
    "isc": "",
    "bsl": r"|-1\.0",
    "busl": r"|-1\.1",
    "cc-by": r"(?:-nc)?(?:-nd|-sa)?(?:-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?:-[a-z]{2,3})?)?",
    "cc0": r"|-1\.0",
    "cecill": r"|-1\.0|-1\.1|-2\.0|-2\.1|-b|-c",
    "artistic": r"|-1\.0(?:-cl8|-perl)?|-2\.0",
    "lppl": r"|-1\.0|-1\.1|-1\.2|-1\.3a|-1\.3c",
    "ms": r"-pl|-rl|-lpl",
    "mulanpsl": r"|-[12]\.0",
    "odbl": r"|-1\.0",
    "odc-by": r"|-1\.0",
    "ofl": r"|-1\.[01](?:-no-rfn|-rfn)?",
    "php": r"|-3\.0|-3\.01",
    "psf": r"|-2\.0",
    "python": r"|-2\.0(?:\.1)?",
    "ruby": "",
    "postgresql": "",
    "openssl": "",
    "curl": "",
    "ncsa": "",
    "ntp": r"|-0",
    "unlicense": "",
    "upl": r"|-1\.0",
    "vim": "",
    "w3c": r"|-19980720|-20150513",
    "wtfpl": "",
    "x11": "",
    "zlib": r"|-acknowledgement",
    "zpl": r"|-1\.1|-2\.0|-2\.1",
}
# Exceptions of the same list that stand behind ``with``.
EXCEPTIONS = frozenset("""
    389-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic bison-exception-2.2
    bootloader-exception classpath-exception-2.0 clisp-exception-2.0 ecos-exception-2.0 fawkes-runtime-exception
    fltk-exception font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception
    gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 i2p-gpl-java-exception
    libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception openjdk-assembly-exception-1.0
    openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1
    qwt-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
_IDENTIFIER = re.compile("|".join(f"(?P<f{i}>{re.escape(name)}(?:{rest}))" for i, (name, rest) in enumerate(FAMILIES.items())))
_LABELS = {f"f{i}": "bsd" if name == "0bsd" else name for i, name in enumerate(FAMILIES)}
#: labels whose obligations end at keeping the notice; an expression is permissive if it can be met with these
PERMISSIVE = frozenset({
    "mit", "apache", "bsd", "isc", "unlicense", "bsl", "cc0", "zlib", "afl", "curl", "mulanpsl", "ncsa", "ntp", "php", "postgresql", "psf",
    "python", "upl", "vim", "w3c", "wtfpl", "x11", "zpl",
})

_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+\-:]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_OUT = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, permissive boolean, unknown array<string>"
)


def family(identifier: str) -> str | None:
    """Label of a licence identifier; None for one that is not on the list."""
    found = _IDENTIFIER.fullmatch(identifier)
    if found is None and identifier.endswith("+"):  # "or later" of any listed version
        found = _IDENTIFIER.fullmatch(identifier[:-1])
    return _LABELS[found.lastgroup] if found else None


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: identifiers and ``or`` < ``and`` < ``with`` in postfix order; the longest
    well-formed start counts, and None means there is none."""
    out: list[str] = []
    ops: list[str] = []
    best: list[str] | None = None
    operand = False  # whether the last token ended an operand
    depth = 0
    for token in _TOKEN.findall(expression):
        if token in _RANK:
            if not operand:
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                out.append(ops.pop())
            ops.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
        if operand and not depth:
            best = out + ops[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[set[str], bool, list[str]]:
    """Labels named in an expression, whether permissive licences alone can meet it (one side of ``or``, both
    sides of ``and``; ``with`` adds an exception to its licence), and names that are on no list. An
    unlisted licence gives no label and is not permissive."""
    stack: list[tuple[set[str], bool]] = []
    unknown = []
    for i, token in enumerate(postfix):
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            elif token == "and":
                stack.append((left[0] | right[0], left[1] and right[1]))
            else:
                stack.append((left[0] | right[0], left[1] or right[1]))
        else:
            exception = postfix[i + 1 : i + 2] == ["with"]
            label = None if exception else family(token)
            if label is None and not (exception and token in EXCEPTIONS):
                unknown.append(token)
            stack.append(({label} - {None}, label in PERMISSIVE))
    return *stack[-1], unknown


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICE_PHRASES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    for phrase in TAGS:
        kinds.setdefault(phrase, []).append(("tag", None))
    for phrase, what in kinds.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, what))
    found.make_automaton()
    return found


def scan_text(text: str | None, found: ahocorasick.Automaton) -> tuple:
    """One row of the result (without the id) of one text."""
    raw = (text or "").encode("utf-8")
    words = raw.translate(_WORDS).split()
    # one character for each byte, so that places in the line are cheap to count
    line = f" {b' '.join(words).decode('latin-1')} "
    base, labels, first, last, n_base, tag = set(), set(), None, None, 0, False
    for end, (back, kinds) in found.iter(line):
        for kind, label in kinds:
            if kind == "tag":
                tag = True
                continue
            labels.add(label)
            if kind == "base":
                start = end - back
                base.add(label)
                n_base += 1
                first = start if first is None or start < first else first
                last = start if last is None or start > last else last
    expressions, open_terms, unknown = [], [], set()
    if tag:
        for spot in _TAG_TEXT.finditer(raw.translate(_LOWER).decode("utf-8")):
            if postfix := to_postfix(spot[1]):
                more, ok, odd = evaluate(postfix)
                unknown.update(odd)
                if more:  # words behind a tag that name no licence are no expression
                    labels |= more
                    open_terms.append(ok)
                    expressions.append(" ".join(postfix))
    # a parsed identifier is certain, a counted phrase nearly, another notice is a hint
    score = 1.0 if expressions else 0.9 if n_base else 0.6 if labels else 0.0
    at = [None if p is None else line.count(" ", 0, p) for p in (first, last)]
    permissive = (all(open_terms) if open_terms else labels <= PERMISSIVE) if labels else None
    return len(words), n_base, *at, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permissive, sorted(unknown)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = automaton()
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()), ("unknown", pa.list_(pa.string())),
    ])
    for batch in batches:
        rows = [scan_text(t.as_py(), found) for t in batch.column("text")]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 10
        arrays = [batch.column("id")] + [pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, without a shuffle.

    ``n_words``; ``n_base`` places of ``BASE_PHRASES``, the smallest and largest word they start
    at (null without one), their labels; all labels (phrases, notices, tagged expressions);
    ``score``; the expressions in postfix order; ``permissive``: whether all of them can be met
    with permissive licences (null without a label); ``unknown``: names behind tags that the lists of
    identifiers and exceptions do not have, which give no label. An expression stands on the line of
    its tag. Labels are distinct, sorted, comma-joined.
    A null text counts as empty (no words, no labels, score 0); a null id and repeated rows are
    kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, _OUT).withColumnRenamed("id", id_col)
