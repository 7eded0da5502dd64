"""Language identification, licence scan and mixing against plain versions and held-out labels."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import documents, frame, ordered
from pyspark.sql import functions as F

from llm import langid
from llm.langid import features, fit, forward_backward, identify, label_texts, learn, sample
from llm.licences import evaluate, family, scan_licences, to_postfix
from llm.mixing import mix, mix_by_weight, route, share_out

SOUNDS = {"en": "the and thing ous ent ing ly er".split(), "fr": "eau oux ment quel aille ch ré".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return fit([(lang, speech(rng, lang, 80)) for lang in SOUNDS for _ in range(40)])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 4])
    e, a = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    gamma, pairs = forward_backward(e, lengths, a)
    want, moves, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(e[at + t, p[t]] for t in range(n)) + sum(a[p[t - 1], p[t]] for t in range(1, n))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for t in range(n):
                want[at + t, p[t]] += w
                if t:
                    moves[p[t - 1], p[t]] += w
        at += n
    assert np.allclose(gamma, want) and np.allclose(pairs, moves)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    one, _ = features(["thing"])
    many, starts = features(["eau", "thing", "a"])
    assert (many[starts[1] : starts[2]] == one).all()


def test_words_of_a_switching_text(model):
    rng = random.Random(7)
    text = speech(rng, "en", 30) + " " + speech(rng, "fr", 30) + " 12 ²"
    gamma, n = label_texts([text, None, "1 2 ²"], model, {}, [np.empty((0, 2), dtype=np.float32)])
    assert n.tolist() == [60, 0, 0]
    best = [model[0][i] for i in gamma.argmax(axis=1)]
    assert sum(b == w for b, w in zip(best, ["en"] * 30 + ["fr"] * 30, strict=True)) >= 56


def test_identify_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, speech(rng, lang, rng.randint(1, 60)), lang, "s", 0, "", "", 0, 0.0, "") for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(1000, None, "en", "s", 0, "", "", 0, 0.0, ""), (1001, "12 !", None, "s", 0, "", "", 0, 0.0, ""), (None, speech(rng, "fr", 20), "fr", "s", 0, "", "", 0, 0.0, "")]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = identify(frame(spark, rows), held).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = [by_id[r[0]].lang_pred == r[2] for r in rows[:120] if by_id[r[0]].held_out]
    assert len(right) > 10 and np.mean(right) > 0.95
    assert (by_id[1000].lang_pred, by_id[1000].score) == (by_id[1001].lang_pred, by_id[1001].score) == ("und", 0.0)
    assert by_id[None].lang_pred == "fr"
    kept = identify(frame(spark, rows), held, keep_columns=True)
    assert kept.columns == [*frame(spark, rows).columns, "lang_pred", "score"]
    assert ordered(kept.select("doc_id", "lang_pred", "text").collect()) == ordered((r[0], by_id[r[0]].lang_pred, r[1]) for r in rows)


def test_sample_passes_over_copies_and_empty_texts(spark):
    rng = random.Random(8)
    texts = [speech(rng, "en", 12) for _ in range(6)]
    rows = [(t, "en") for t in texts + [texts[0]] * 30 + ["", " 1 2 ", "--"] * 30] + [("eau", "fr"), (None, "fr"), ("word", None)]
    got = [(r.lang, r.text) for r in sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", sample_rows=5).collect()]
    en = [t for lang, t in got if lang == "en"]
    assert len(en) == len(set(en)) == 5 and set(en) <= set(texts) and sorted(t for lang, t in got if lang == "fr") == ["eau"]


@pytest.mark.parametrize("part_rows", [200, 10])
def test_fit_in_tasks(spark, monkeypatch, part_rows):
    """One part gives the weights of a fit in one process, several give a field that labels as well."""
    rng = random.Random(9)
    rows = [(speech(rng, lang, 60), lang) for lang in SOUNDS for _ in range(40)]
    monkeypatch.setattr(langid, "PART_ROWS", part_rows)
    labels, weights, transitions = learn(spark.createDataFrame(rows, "text string, lang string").repartition(4), "text", "lang", rounds=6)
    want = fit([(lang, t) for t, lang in rows], rounds=6)
    assert labels == want[0] == ["en", "fr"] and np.abs(weights).max() > 0.1
    if part_rows == 200:
        assert np.allclose(weights, want[1], atol=1e-4) and np.allclose(transitions, want[2], atol=1e-4)
    gamma, _ = label_texts([speech(rng, "en", 40), speech(rng, "fr", 40)], (labels, weights, transitions), {}, [np.empty((0, 2), dtype=np.float32)])
    assert (gamma.argmax(axis=1) == np.repeat([0, 1], 40)).mean() > 0.9


def test_identify_without_anything_to_learn_from(spark):
    rows = [(i, "some words", None, "s", 0, "", "", 0, 0.0, "") for i in range(3)]
    assert {(r.lang_pred, r.score) for r in identify(frame(spark, rows), F.lit(False)).collect()} == {("und", 0.0)}
    assert identify(frame(spark, []).limit(0), F.lit(False)).collect() == []


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_scan(i, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(at, label) for p, label in PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
    starts = [at for at, _ in found]
    return i, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_scan(spark):
    more = ["MIT License mit license, apache\nLICENSE", "the gnu general-public license general public", "mit licenses", "xmit license", "É MIT\x00License"]
    rows = documents() + [(900 + i, t, None, None, 0, "", "", 0, 0.0, "") for i, t in enumerate(more)]
    out = scan_licences(frame(spark, rows)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out]
    assert ordered(got) == ordered(plain_scan(r[0], r[1]) for r in rows)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    tagged = next(r for r in out if r.expressions)
    assert tagged.labels == "apache,bsd,gpl,mit" and tagged.expressions == ["apache-2.0 gpl-2.0-only or bsd-3-clause and"] and tagged.permissive
    assert scan_licences(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, postfix, labels, permissive",
    [
        ("mit", "mit", {"mit"}, True),
        ("mit or gpl-2.0 and apache-2.0", "mit gpl-2.0 apache-2.0 and or", {"mit", "gpl", "apache"}, True),
        ("(mit or gpl-2.0) and lgpl-3.0+", "mit gpl-2.0 or lgpl-3.0+ and", {"mit", "gpl", "lgpl"}, False),
        ("gpl-2.0 with classpath-exception-2.0 or isc", "gpl-2.0 classpath-exception-2.0 with isc or", {"gpl", "isc"}, True),
        ("mit and", "mit", {"mit"}, True),
        ("mit license text", "mit", {"mit"}, True),
        ("((mit)", None, None, None),
        ("or mit", None, None, None),
        ("", None, None, None),
        (") mit", None, None, None),
    ],
)
def test_expressions(text, postfix, labels, permissive):
    out = to_postfix(text)
    assert out == (postfix.split(" ") if postfix else None)
    if out:
        assert evaluate(out) == (labels, permissive, [])


def test_families():
    known = ("mit", "gpl-3.0-or-later", "cc-by-sa-4.0", "0bsd", "bsd-3-clause-clear", "apache-2.0+", "unlicense")
    assert [family(x) for x in known] == ["mit", "gpl", "cc-by", "bsd", "bsd", "apache", "unlicense"]
    assert [family(x) for x in ("gplus", "gpl-9.0", "see", "license", "licenseref-own", "", "mit-")] == [None] * 7


@pytest.mark.parametrize(
    "text, labels, unknown",
    [
        ("SPDX-License-Identifier: see LICENSE", "", ["see"]),
        ("SPDX-License-Identifier:\nThis file is part of X", "", []),
        ("SPDX-License-Identifier:\r\n mit", "", []),
        ("spdx-license-identifier \t:\t MIT\n or gpl-2.0", "mit", []),
        ("License-Expression: LicenseRef-own AND BSD-3-Clause", "bsd", ["licenseref-own"]),
        ("SPDX-License-Identifier: gpl-2.0 with own-exception", "gpl", ["own-exception"]),
        ("SPDX-License-Identifier: gpl-2.0 with gcc-exception-3.1", "gpl", []),
    ],
)
def test_tags_give_listed_licences_only(spark, text, labels, unknown):
    row = scan_licences(frame(spark, [(1, text, None, None, 0, "", "", 0, 0.0, "")])).first()
    assert (row.labels, row.unknown, bool(row.expressions)) == (labels, unknown, bool(labels))
    assert row.permissive is None if not labels else row.permissive == (labels in ("mit",))


def test_shares_stop_at_limits():
    assert share_out(12, [3, 1, 2], [4, 100, 100]) == [4.0, pytest.approx(8 / 3), pytest.approx(16 / 3)]
    assert share_out(100, [1, 1], [5, 6]) == [5.0, 6.0] and share_out(0, [1], [0]) == [0.0] and share_out(5, [], []) == []


def test_many_sources_without_overlaps_need_no_search():
    sizes = {(f"s{i}",): 10 + i % 7 for i in range(10_000)}
    weights, limits = [3 - i % 3 for i in range(10_000)], [2 * n for n in sizes.values()]
    targets = share_out(1.5 * sum(sizes.values()), weights, limits)
    assert sum(targets) == pytest.approx(1.5 * sum(sizes.values())) and all(0 <= t <= n for t, n in zip(targets, limits, strict=True))
    quotas = {p[0]: round(t) for p, t in zip(sizes, targets, strict=True)}
    assert route(sizes, quotas) == {p: quotas[p[0]] for p in sizes}
    few = {(f"s{i}",): 10 + i for i in range(6)}
    wanted = {"s0": 99, "s1": 3, "s2": 20, "s3": 0, "s4": 14, "gone": 5}
    flow_only = route(few | {("s0", "s1"): 0}, wanted)  # an empty pattern with a choice makes it search
    assert route(few, wanted) == {p: n for p, n in flow_only.items() if len(p) == 1}


def best_cost(sizes, quotas, repeats):
    """Least repetition cost of meeting as much of the quotas as can be met, by trying all splits."""
    best = None
    for amounts in itertools.product(*[range(n * repeats + 1) for n in sizes.values()]):
        left = dict(quotas)
        flows = [collections.Counter() for _ in amounts]

        def feasible(k):
            if k == len(amounts):
                return True
            pattern = list(sizes)[k]
            for first in range(amounts[k] + 1) if len(pattern) == 2 else [amounts[k]]:
                split = dict(zip(pattern, (first, amounts[k] - first), strict=False))
                if all(left[s] >= v for s, v in split.items()):
                    for s, v in split.items():
                        left[s] -= v
                    if feasible(k + 1):
                        return True
                    for s, v in split.items():
                        left[s] += v
            return False

        del flows
        if feasible(0):
            cost = sum(max(0, a - n) for a, n in zip(amounts, sizes.values(), strict=True))
            best = max(best, (sum(amounts), -cost)) if best else (sum(amounts), -cost)
    return best


def test_flow_is_of_least_cost():
    rng = random.Random(5)
    for _ in range(12):
        sizes = {("a",): rng.randint(0, 3), ("a", "b"): rng.randint(1, 3), ("b",): rng.randint(0, 3)}
        quotas = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
        taken = route(sizes, quotas, 2)
        cost = sum(max(0, taken[p] - n) for p, n in sizes.items())
        assert (sum(taken.values()), -cost) == best_cost(sizes, quotas, 2)


def test_mix_by_weight(spark):
    rng = random.Random(6)
    rows = documents() + [(2000 + i, " ".join(["w"] * rng.randint(0, 30)), None, rng.choice(["a", "b", None]), 0, "", "", 0, 0.0, "") for i in range(300)]
    out = mix_by_weight(frame(spark, rows))
    again = mix_by_weight(frame(spark, rows).repartition(7))
    assert ordered(out.select("doc_id", "size", "taken").collect()) == ordered(again.select("doc_id", "size", "taken").collect())
    got = out.collect()
    assert ordered((r.doc_id, r.size) for r in got) == ordered((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.source_size == sum(len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows if x[3] == r.source)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = share_out(1.5 * sum(sizes.values()), [(3, 1, 2)[i % 3] for i in range(len(order))], [2 * sizes[s] for s in order])
    assert [targets[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)
    assert mix_by_weight(frame(spark, []).limit(0)).collect() == []


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "b"], 5 + i % 4) for i in range(60)] + [(99, None, 7), (98, ["a"], None), (97, ["c"], 4)]
    docs = spark.createDataFrame(rows, "i long, s array<string>, n int")
    got = {r.i: r for r in mix(docs, "s", "n", "i", {"a": 300, "b": 150}, 2, seed=3).collect()}
    assert len(got) == len(rows) and sum(r.taken for r in got.values()) == 450
    assert got[99].taken == got[98].taken == got[97].taken == 0
    # a alone holds less than its quota, so what both hold goes there before anything is repeated
    assert all(r.taken <= 2 * (r.n or 0) for r in got.values())
