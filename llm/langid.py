"""Language identification by a linear-chain conditional random field over words.

Each word gets a label; its features are character n-grams of the word between border marks
(those that touch a mark are its affixes) and the word itself (lexicon), hashed into one table
of weights. Transition weights between neighbouring labels are learned as well, so a word is
read in its context and text that switches languages is labelled word by word. Posteriors come
from forward-backward; a text's language is the label with the largest mean posterior.

The field is fitted on a bounded sample of the labelled rows (``SAMPLE_ROWS`` different texts for
each language; of a text longer than ``SAMPLE_CHARS`` characters ``SAMPLE_PIECES`` pieces spread evenly over
all of it; it grows with the number of languages only and
lies in the tasks, not in the driver); every text is labelled whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SAMPLE_ROWS = 400
SAMPLE_CHARS = 2000
SAMPLE_PIECES = 4
ROUNDS = 25
PIECE = 40
PART_ROWS = 200
FIXED = float(1 << 24)
GRADIENT_ROWS = 1 << 14
FEATURE_BITS = 18
NGRAMS = (2, 3, 4, 5)
CACHED_WORDS = 500_000
GROUP_CHARS = 3_000_000
UNKNOWN = "und"
#: a word is in doubt if its best posterior lies less than this share of the way from chance (one in as many as there are labels) to certainty
LEAST_ABOVE_CHANCE = 0.15

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUT = "id long, held_out boolean, lang_pred string, score double, n_words long, words_by_lang string"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) | 1  # 0 stays free for "no feature"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers by position of the marked words, and where each word begins."""
    line = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters up to the word's end
    out = np.zeros((len(chars), len(NGRAMS) + 1), dtype=np.int64)
    h, at = np.zeros(len(chars), dtype=np.uint64), 0
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros_like(chars)
        shifted[: len(chars) - n + 1] = chars[n - 1 :]
        h = h * np.uint64(1_000_003) + shifted
        if n in NGRAMS:
            out[:, at] = np.where(left >= n, _hashed(h, n), 0)
            at += 1
    power = np.arange(len(chars)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(_hashed(chars, 77).astype(np.uint64) * (_MIX ** (power.astype(np.uint64) + np.uint64(1))), starts)
    out[starts, -1] = _hashed(whole, 99)
    return out, starts


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    idx, starts = features(words)
    return np.add.reduceat(weights[idx].sum(axis=1), starts, axis=0)


def forward_backward(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every position of many sequences that lie one after the other in ``e``,
    and the expected transition counts (zeros without ``counts``: only the fit needs them). All
    sequences advance together, longest first."""
    n, labels = e.shape
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    b = np.exp(e - e.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    alpha, beta = np.empty((n, labels)), np.ones((n, labels))
    for t, live in enumerate(active):
        rows = first[:live] + t
        now = b[rows] if t == 0 else (alpha[rows - 1] @ step) * b[rows]
        alpha[rows] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(len(active) - 1, 0, -1):
        rows = first[: active[t]] + t
        ahead = b[rows] * beta[rows]
        now = ahead @ step.T
        beta[rows - 1] = now / now.sum(axis=1, keepdims=True)
        if not counts:
            continue
        a = alpha[rows - 1]
        scale = 1 / np.einsum("ni,ij,nj->n", a, step, ahead, optimize=True)
        pairs += step * ((a * scale[:, None]).T @ ahead)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), pairs


def prepare(rows: list[tuple[str, str]], labels: list[str], piece: int = PIECE, seed: int = 7) -> dict[str, np.ndarray] | None:
    """What the rounds of a fit read of ``(language, text)`` pairs; None if they have no word.

    Sequences of ``piece`` words are cut from the texts; half of them are then joined from two
    halves of different sequences, so that transitions between languages are seen as well.
    """
    rng = np.random.default_rng(seed)
    at = {lang: i for i, lang in enumerate(labels)}
    runs: list[tuple[list[str], list[int]]] = []
    for lang, text in sorted(rows):
        words = words_of(text)
        for i in range(0, len(words), piece):
            part = words[i : i + piece]
            runs.append((part, [at[lang]] * len(part)))
    half = piece // 2
    mixed = []
    for i, j in rng.permutation(len(runs))[: len(runs) // 2 * 2].reshape(-1, 2) if len(runs) > 1 else []:
        (wa, la), (wb, lb) = runs[i], runs[j]
        mixed.append((wa[:half] + wb[:half], la[:half] + lb[:half]))
    runs += mixed
    if not runs:
        return None
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for words, _ in runs for w in words], dtype=np.int32)
    gold = np.array([x for _, ls in runs for x in ls], dtype=np.int32)
    lengths = np.array([len(words) for words, _ in runs], dtype=np.int32)
    idx, starts = features(list(ids))
    # feature numbers are odd, 0 is none: every second one is left out
    return {"seq": seq, "gold": gold, "lengths": lengths, "idx": ((idx + 1) >> 1).astype(np.int32), "starts": starts.astype(np.int32)}


def gradient(part: dict[str, np.ndarray], w: np.ndarray, transitions: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood of one part, feature weights before transition weights, one row
    after the other, in whole multiples of ``1 / FIXED``: sums of them do not depend on the order."""
    n, labels = len(part["seq"]), w.shape[1]
    seq, gold, lengths, idx, starts = (part[k] for k in ("seq", "gold", "lengths", "idx", "starts"))
    by_place = w[idx[:, 0]]
    for f in range(1, idx.shape[1]):  # one feature kind at a time keeps the task small
        by_place += w[idx[:, f]]
    by_word = np.add.reduceat(by_place, starts, axis=0)
    gamma, pairs = forward_backward(by_word[seq], lengths.astype(np.int64), transitions)
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    seen = np.zeros_like(transitions)
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    diff = -gamma
    diff[np.arange(n), gold] += 1
    diff *= share[gold][:, None]
    per_word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(idx))))
    grad = np.zeros_like(w)
    for c in range(labels):
        spread = np.bincount(seq, diff[:, c], len(starts))[per_word]
        for f in range(idx.shape[1]):
            grad[:, c] += np.bincount(idx[:, f], spread, len(w))
    grad[0] = 0
    return np.rint(np.concatenate([grad, seen - pairs]) * FIXED).astype(np.int64)


def climb(labels: list[str], counts: np.ndarray, total: Callable, rounds: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model from ``total(w, transitions, share)``, the sum of the gradients of all parts; ``counts``
    are the words of each label. Nothing here is larger than the weights."""
    size = (1 << (FEATURE_BITS - 1)) + 1
    weights, transitions = np.zeros((1 << FEATURE_BITS, len(labels)), dtype=np.float32), np.zeros((len(labels), len(labels)))
    if not counts.sum() or len(labels) < 2:
        return labels, weights, transitions
    # languages weigh alike, however unevenly they are sampled
    share = counts.sum() / len(labels) / np.maximum(counts, 1)
    w = np.zeros((size, len(labels)))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(transitions), np.zeros_like(transitions)]
    for k in range(1, rounds + 1):
        summed = total(w, transitions, share)
        for x, g, m, v, rate in ((w, summed[:size] / FIXED, *moments[:2], 0.05), (transitions, summed[size:] / FIXED, *moments[2:], 0.05)):
            g -= 0.05 * x
            m += 0.1 * (g - m)
            g *= g
            g -= v
            v += 0.01 * g
            x += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    weights[1::2] = w[1:]
    return labels, weights, transitions


def fit(samples: list[tuple[str, str]], rounds: int = ROUNDS, piece: int = PIECE, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, feature weights and transition weights from ``(language, text)`` pairs, in this process."""
    labels = sorted({lang for lang, _ in samples})
    part = prepare(samples, labels, piece, seed)
    counts = np.bincount(part["gold"] if part else [], minlength=len(labels))
    return climb(labels, counts, lambda *now: gradient(part, *now), rounds)


def label_texts(texts: list[str | None], model, cache: dict[str, int], table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words of all texts, one after the other, and the texts' word counts.
    ``cache`` and ``table`` keep the emission scores of words met before; a run of word
    characters without a letter is no word (-1)."""
    _, weights, transitions = model
    new: list[str] = []
    numbers, lengths = [], []
    for text in texts:
        row = []
        for w in words_of(text):
            i = cache.get(w)
            if i is None:
                if w.isalpha() or any(map(str.isalpha, w)):
                    i = cache[w] = len(table[0]) + len(new)
                    new.append(w)
                else:
                    i = cache[w] = -1
            if i >= 0:
                row.append(i)
        numbers.extend(row)
        lengths.append(len(row))
    for i in range(0, len(new), 20_000):
        table.append(emissions(new[i : i + 20_000], weights))
    if len(table) > 1:
        table[:] = [np.concatenate(table)]
    lengths = np.array(lengths, dtype=np.int64)
    some = lengths[lengths > 0]
    if not len(some) or not len(transitions):
        return np.empty((0, transitions.shape[0])), lengths
    return forward_backward(table[0][np.array(numbers, dtype=np.int64)].astype(np.float64), some, transitions, counts=False)[0], lengths


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Texts of like length together, longest first, ``GROUP_CHARS`` in a group: sequences of a
    group advance together, and a group bounds the memory (a longer text is a group of its own)."""
    group, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")):
        if group and held + len(texts[i] or "") > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(texts[i] or "")
    if group:
        yield group


def _predict(batches: Iterator[pa.RecordBatch], model, keep: list[str], results: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``keep`` and those of the results."""
    labels = model[0]
    cache: dict[str, int] = {}
    rows = [np.empty((0, len(labels)), dtype=np.float32)]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        pred, score, by_lang = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
        counts, doubt = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        least = (1 + LEAST_ABOVE_CHANCE * (len(labels) - 1)) / max(len(labels), 1)
        for group in _groups(texts):
            gamma, lengths = label_texts([texts[i] for i in group], model, cache, rows)
            counts[group] = lengths
            if labels and len(gamma):
                some = np.flatnonzero(lengths > 0)
                starts = np.cumsum(lengths[some]) - lengths[some]
                mean = np.add.reduceat(gamma, starts, axis=0) / lengths[some][:, None]
                best = mean.argmax(axis=1)  # of equal ones the first: labels are sorted
                hits = np.add.reduceat(np.eye(len(labels), dtype=np.int32)[gamma.argmax(axis=1)], starts, axis=0)
                unsure = np.add.reduceat((gamma.max(axis=1) < least - 1e-9).astype(np.float64), starts) / lengths[some]
                for j, k, m, h, u in zip(some, best, mean, hits, unsure, strict=True):
                    i = group[j]
                    doubt[i] = u
                    pred[i], score[i] = labels[k], min(1.0, float(m[k]))
                    by_lang[i] = ",".join(f"{labels[x]}:{h[x]}" for x in np.flatnonzero(h))
            if len(cache) > CACHED_WORDS:
                cache.clear()
                rows[:] = [rows[0][:0]]
        out = {
            "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "n_words": pa.array(counts),
            "words_by_lang": pa.array(by_lang, pa.string()), "doubt": pa.array(doubt),
        }
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(out[c] for c in results)], names=[*keep, *results])


def sample(train: DataFrame, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``lang, text, h``: ``sample_rows`` different texts of each language, picked by hash; of a text longer than
    ``sample_chars`` pieces that are spread evenly over it, from its beginning to its end, without the words their
    borders cut. Rows without a language or a letter to learn from are passed over."""
    text, lang = F.col(text_col), F.col(lang_col)
    size = sample_chars // SAMPLE_PIECES
    places = [(F.floor((F.length(text) - size) * i / (SAMPLE_PIECES - 1)) + 1).cast("int") for i in range(SAMPLE_PIECES)]
    pieces = [F.regexp_replace(F.substring(text, at, F.lit(size)), r"^\S*\s+|\s+\S*$", "") for at in places]
    taken = F.when(F.length(text) > sample_chars, F.concat_ws(" ", *pieces)).otherwise(text)
    rows = train.filter(lang.isNotNull() & text.rlike(r"[\p{L}]")).select(lang.cast("string").alias("lang"), text.alias("text"), taken.alias("taken"))
    rows = rows.select("lang", F.col("taken").alias("text"), F.xxhash64("text").alias("h"))
    # hashes without copies first, combined by each map task, so neither copies nor texts meet in a task;
    # those picked are ``sample_rows`` longs a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = rows.select("lang", "h").distinct().withColumn("r", rank).filter(F.col("r") <= sample_rows).select("lang", "h")
    return rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text", "h")


def learn(train: DataFrame, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, rounds: int = ROUNDS):
    """Fit the field on the ``sample``. It stays in the tasks: parts of ``PART_ROWS`` texts are prepared and
    stored once, each round sums their gradients in Spark, and the driver holds the weights only."""
    sc = train.sparkSession.sparkContext
    picked = stored(sample(train, text_col, lang_col, sample_rows, sample_chars), "language-sample")
    sizes = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    labels = sorted(sizes)

    def parts(batches):
        rows: list[tuple[str, str]] = []

        def packed(rows):
            part = prepare(rows, labels)
            if part:
                counts = np.bincount(part["gold"], minlength=len(labels))
                return pa.RecordBatch.from_arrays(
                    [pa.array([pickle.dumps(part)], pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["part", "counts"]
                )

        for batch in batches:
            rows += zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            while len(rows) > 2 * PART_ROWS:
                yield packed(rows[:PART_ROWS])
                rows = rows[PART_ROWS:]
        if rows and (last := packed(rows)):
            yield last

    # dealt out by hash, so that a part has texts of all languages
    dealt = picked.repartition(max(1, round(sum(sizes.values()) / PART_ROWS)), "h").sortWithinPartitions("h", "lang", "text")
    prepared = stored(dealt.select("lang", "text").mapInArrow(parts, "part binary, counts array<long>"), "language-parts")
    discard(picked)
    counts = np.zeros(len(labels), dtype=np.int64)
    for r in prepared.select(F.posexplode("counts")).groupBy("pos").sum("col").collect():
        counts[r[0]] = r[1]
    rows = prepared.select("part").rdd

    def total(w, transitions, share):
        now = sc.broadcast((w, transitions, share))

        def of_task(found):
            out = None
            for r in found:
                g = gradient(pickle.loads(r[0]), *now.value)
                out = g if out is None else np.add(out, g, out=out)
            for at in range(0, 0 if out is None else len(out), GRADIENT_ROWS):
                yield at, out[at : at + GRADIENT_ROWS]

        sums = rows.mapPartitions(of_task).reduceByKey(np.add)
        got = sums.collect()
        sums._jrdd.rdd().cleanShuffleDependencies(True)  # else the shuffles of all rounds stay on disk
        now.destroy()
        return np.concatenate([g for _, g in sorted(got, key=lambda x: x[0])])

    model = climb(labels, counts, total, rounds)
    discard(prepared)
    return model


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_columns: bool = False,
    doubt: bool = False, as_row: bool = False,
) -> DataFrame:
    """Language of every row of ``docs``: ``id, held_out, lang_pred, score, n_words, words_by_lang``,
    or with ``keep_columns`` all its columns, ``lang_pred`` and ``score`` (replaced where they exist; with
    ``as_row`` all columns stay as they are, in the struct ``row``); with ``doubt`` as well also ``doubt``, the share of the text's words whose best posterior is near chance
    (``LEAST_ABOVE_CHANCE``). With a single label there is nothing to doubt.

    The field is learned from rows where ``held_out`` is false and the language is known; rows
    where it is null are neither learned from nor held out. A text that is null or has no letter
    is ``und`` with score 0, and so is every text if there is nothing to learn from. The score is
    the mean posterior of the predicted label over the text's words; ``words_by_lang`` counts
    words by their own best label. Ties go to the smaller label. Null and repeated ids are kept
    row by row; other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = learn(docs.filter(~held_out), text_col, lang_col)
    shared = spark.sparkContext.broadcast(model)
    if keep_columns:
        added = ["lang_pred", "score"] + ["doubt"] * doubt
        whole = F.struct(*[c for c in docs.columns if as_row or c not in added]).alias("row")
        rows = docs.select(whole, F.col(text_col).alias("text"))
        schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double" + ", doubt double" * doubt
        return rows.mapInArrow(lambda it: _predict(it, shared.value, ["row"], added), schema).select("row" if as_row else "row.*", *added)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(lambda it: _predict(it, shared.value, ["id", "held_out"], ["lang_pred", "score", "n_words", "words_by_lang"]), _OUT).withColumnRenamed("id", id_col)
