"""Small documents with the awkward cases, and plain versions of what the operators compute."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k string, size int, target double, `row` string"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = passage(rng, 60)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (10, 30, 50)]
    lines = [passage(rng, 12) for _ in range(8)]
    texts = [
        base, base, *near, None, "", " \n\t ", "7 % 8", "Of.", "of", "\n".join(lines[:5]), "\n".join(lines[2:]),
        "\n".join([lines[0] + "x", "", lines[1].upper(), "own line of this text"]), passage(rng, 4000), "a" * 3000, "é ß 漢字 ́ \U0001f600",
        "Released under the MIT License. SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only) AND BSD-3-Clause",
        "GNU General Public License; mit license mit   LICENSE <|endoftext|> it's <|endof",
    ]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(None, "a text without id", None, None), (None, base, "en", "s1"), (3, near[1], "en", "s3"), (3, near[1], "en", "s3"), (3, "other text of three", "fr", "s0")]
    return [(i, t, lang, s, len(t or ""), "x", "y", 1, 2.0, "z") for i, t, lang, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
