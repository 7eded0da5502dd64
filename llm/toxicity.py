"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's embedding is the mean of the vectors of its subwords: the word itself between border marks
and its character n-grams of ``NGRAMS`` characters, hashed into a table of ``1 << TABLE_BITS``
vectors. Misspellings that were never seen share n-grams with words that were, and so their
vectors. The embeddings of a window of ``WINDOW`` words are averaged and go through a linear
softmax over the two labels; table, weights and bias are trained jointly in numpy.

An insult in a long text would vanish in the average of all its words, so a text is as toxic as its
worst window (windows begin every ``STRIDE`` words and cover the whole text). Fitting does the same:
each round the gradient of a text goes through the window that scores highest at that time.

The fit uses a bounded sample: ``SAMPLE_ROWS`` different texts a label, picked by hash, of each the whole
text, or ``SAMPLE_WINDOWS`` windows spread evenly over all of it. The share of the labels among all
labelled texts corrects the bias afterwards. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SAMPLE_ROWS = 3000
SAMPLE_WINDOWS = 96
WINDOW = 32
STRIDE = 16
#: a window of fewer words is averaged as if it had so many
LEAST_WORDS = 8
#: averages are multiplied by this before the softmax, so that weights of size 1 can tell labels apart
SCALE = 16.0
NGRAMS = (3, 4, 5, 6)
TABLE_BITS = 17
SIZE = 8
ROUNDS = 40
RATE = 0.1
DECAY = 1e-4
#: a row of the table is learned if so many different (text, word) pairs of the sample have it
LEAST_SEEN = 10
LONGEST_WORD = 64
CACHED_WORDS = 500_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; one of more than ``LONGEST_WORD`` characters counts as several."""
    words = _WORD.findall((text or "").lower())
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the subwords of each word, one word after the other, and how many each has."""
    line = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(chars))
    rows, owner = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros_like(chars)
        shifted[: len(chars) - n + 1] = chars[n - 1 :]
        h = h * np.uint64(1_000_003) + shifted
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
            rows.append(h[at] * np.uint64(2 * n + 1))
            owner.append(word[at])
    step = (np.arange(len(chars)) - (ends - sizes)[word]).astype(np.uint64)
    rows.append(np.add.reduceat((chars + np.uint64(7)) * _MIX ** (step + np.uint64(1)), ends - sizes))
    owner.append(np.arange(len(words)))
    values, owner = np.concatenate(rows) * _MIX, np.concatenate(owner)
    values ^= values >> np.uint64(31)
    values = (values * _MIX) >> np.uint64(64 - TABLE_BITS)
    order = np.argsort(owner, kind="stable")
    return values[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the windows of texts with so many words, which lie one after the other.
    Each text has one at least."""
    each = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    base = (np.cumsum(lengths) - lengths)[text]
    begin = base + number * STRIDE
    return begin, np.minimum(begin + WINDOW, base + lengths[text]), text


def _means(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Averages of the words' values in each window, times ``SCALE``; what a window gives depends on its words only."""
    edges = np.stack([begin, end], axis=1).ravel()
    total = np.where(begin < end, np.add.reduceat(np.append(values, 0.0), edges)[::2], 0.0)
    return total * SCALE / np.maximum(end - begin, LEAST_WORDS)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the stretches that begin at ``starts``, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _by_owner(owner: np.ndarray, rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[:, rows]`` for each of ``n`` owners, one component after the other."""
    return np.stack([np.bincount(owner, weights=v[rows], minlength=n) for v in values])


class Model:
    """Subword table (0 for subwords never learned), softmax weights and bias."""

    def __init__(self) -> None:
        self.table = np.zeros((SIZE, 1 << TABLE_BITS))
        self.weights = np.random.default_rng(13).uniform(-1, 1, (SIZE, 2))
        self.bias = np.zeros(2)

    def by_subword(self) -> np.ndarray:
        """By how much each subword speaks for label 1: its vector through the difference of the weights."""
        return (self.weights[:, 1] - self.weights[:, 0]) @ self.table


def margins(words: list[str], by_subword: np.ndarray) -> np.ndarray:
    """By how much each word speaks for label 1: the mean over its subwords."""
    rows, counts = subwords(words)
    return np.add.reduceat(by_subword[rows], np.cumsum(counts) - counts) / counts


class Fit:
    """Texts as numbers of their words, words as rows of the table that enough of the texts' words have."""

    def __init__(self, texts: Iterable[list[str]], labels: np.ndarray):
        known: dict[str, int] = {}
        # a text's words are numbered and let go
        parts = [np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32) for words in texts]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.numbers = np.concatenate([*parts, np.empty(0, np.int32)])
        once = np.unique(np.repeat(np.arange(len(parts)), lengths) * len(known) + self.numbers) % max(len(known), 1)
        in_texts = np.bincount(once, minlength=len(known))
        words, size = list(known), 1 << TABLE_BITS
        seen, rows, self.counts = np.zeros(size), [], []
        for at in range(0, len(words), 20_000):
            r, c = subwords(words[at : at + 20_000])
            seen += np.bincount(r, weights=np.repeat(in_texts[at : at + 20_000], c), minlength=size)
            rows.append(r.astype(np.int32))
            self.counts.append(c)
        live = seen >= LEAST_SEEN
        # a word's mean is over all its subwords; those seen too rarely stay 0
        self.sizes = np.concatenate([np.add.reduceat(live[r].astype(np.int64), np.cumsum(c) - c) for r, c in zip(rows, self.counts, strict=True)] or [np.empty(0, np.int64)])
        self.rows = np.concatenate([r[live[r]] for r in rows] or [np.empty(0, np.int32)])
        self.counts = np.concatenate(self.counts or [np.empty(0, np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.begin, self.end, self.text = windows(lengths)
        self.first = np.searchsorted(self.text, np.arange(len(parts)))
        self.labels = labels
        self.share = 0.5 / np.bincount(labels, minlength=2)[labels]  # both labels weigh the same

    def worst(self, model: Model) -> np.ndarray:
        """The window of each text that speaks most for label 1."""
        total = np.concatenate([[0.0], np.cumsum(model.by_subword()[self.rows])])
        by_word = (total[self.starts + self.sizes] - total[self.starts]) / self.counts
        margin = _means(by_word[self.numbers], self.begin, self.end)
        return np.lexsort((-margin, self.text))[self.first]

    def gradients(self, model: Model) -> list[np.ndarray]:
        """Of the cross entropy of each text's worst window, by table, weights and bias."""
        best = self.worst(model)
        begin, size = self.begin[best], (self.end - self.begin)[best]
        n = np.maximum(size, LEAST_WORDS) / SCALE
        owner = np.repeat(np.arange(len(best)), size)
        words, place = np.unique(self.numbers[_spread(begin, size)], return_inverse=True)
        rows = self.rows[_spread(self.starts[words], self.sizes[words])]
        word = np.repeat(np.arange(len(words)), self.sizes[words])
        counts = self.counts[words]
        emb = _by_owner(word, rows, model.table, len(words)) / counts
        mean = _by_owner(owner, place, emb, len(best)) / n
        logits = mean.T @ model.weights + model.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(best)), self.labels] -= 1
        p *= self.share[:, None]
        by_word = _by_owner(place, owner, (model.weights @ p.T) / n, len(words)) / counts
        return [_by_owner(rows, word, by_word, model.table.shape[1]), mean @ p, p.sum(axis=0)]


def fit(texts: Iterable[list[str]], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Adam over all texts each round, table, weights and bias together; the table is held small by ``DECAY``."""
    model = Model()
    if len(set(labels.tolist())) < 2:
        return model
    work = Fit(texts, labels)
    if not len(work.numbers):
        return model
    params = (model.table, model.weights, model.bias)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for turn in range(1, rounds + 1):
        grads = work.gradients(model)
        grads[0] += DECAY * model.table
        for param, grad, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, use: Column, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``label, text`` of the sample, and how many different texts each label has in all.

    A text under several labels counts as 1 if any of its rows does; rows without id or label teach nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.filter(use).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).dropna()
    # ids and hashes only, copies combined before the join
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    rows = hashed.distinct().join(marks, "id").groupBy("h").agg(F.max("label").alias("label"))
    rows = stored(rows, "labelled")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # counts by the first bits of the hash tell how far down the order the sample goes; only rows up to there
    # are ranked: ``sample_rows`` a label and what the last of these buckets has besides
    bucket = F.shiftrightunsigned("h", 48)
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    wanted = rows.groupBy("label", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample_rows).select("label", "bucket")
    near = rows.withColumn("bucket", bucket).join(F.broadcast(wanted), ["label", "bucket"])  # at most 2 * sample_rows buckets
    rank = F.row_number().over(Window.partitionBy("label").orderBy("bucket", "h"))
    picked = near.withColumn("r", rank).filter(F.col("r") <= sample_rows).select("h", "label")  # at most 2 * sample_rows rows
    whole = docs.select(text.alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), "h")
    return whole.groupBy("h", "label").agg(F.min("text").alias("text")).select("h", "label", "text"), sizes


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of whole texts; of a very long one, those of windows spread evenly over it."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            if len(words) > SAMPLE_WINDOWS * WINDOW:
                at = np.linspace(0, len(words) - WINDOW, SAMPLE_WINDOWS).astype(int)
                words = [w for i in at.tolist() for w in words[i : i + WINDOW]]
            out.append(" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array(out, pa.string())], names=["h", "label", "words"])


def learn(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS,
) -> tuple[Model, float]:
    """The model, and what the share of the labels adds to the margin of label 1."""
    picked, sizes = sample(docs, labels, use, id_col, text_col, label_col, sample_rows)
    words = stored(picked.mapInArrow(_clips, "h long, label int, words string"), "toxic-sample")
    # at most 2 * sample_rows texts of SAMPLE_WINDOWS * WINDOW words
    got = words.toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    discard(words)
    model = fit((w.as_py().split() for w in got.column("words")), got.column("label").to_numpy().astype(np.int64), rounds)
    # the fit takes both labels as equally frequent; without any label nothing speaks for 1
    return model, float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))) if sizes else -5.0


def _score(batches: Iterator[pa.RecordBatch], model: Model, prior: float) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    known = np.empty(0)
    bias = float(model.bias[1] - model.bias[0]) + prior
    by_subword = model.by_subword()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            numbers, lengths, fresh = [], [], []
            for text in part.column("text"):
                words = words_of(text.as_py())
                lengths.append(len(words))
                for w in words:
                    if w not in cache:
                        cache[w] = len(cache)
                        fresh.append(w)
                numbers.append(np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words)))
            more = [margins(fresh[i : i + 20_000], by_subword) for i in range(0, len(fresh), 20_000)]
            known = np.concatenate([known, *more])
            begin, end, text = windows(np.array(lengths, dtype=np.int64))
            found = _means(known[np.concatenate(numbers)], begin, end)
            worst = np.maximum.reduceat(found, np.searchsorted(text, np.arange(part.num_rows))) + bias
            score = 1 / (1 + np.exp(-np.clip(worst, -500, 500)))
            if len(cache) > CACHED_WORDS:
                cache.clear()
                known = known[:0]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options,
) -> DataFrame:
    """``id, held_out, score, predicted`` of every row of ``docs``: the posterior of label 1 for its worst
    window, and whether it is at least ``THRESHOLD``.

    Learned from rows where ``held_out`` is false and ``labels`` (joined by id) has a label. A row where
    it is null (a null id) is neither learned from nor held out. Null and empty texts have a window
    without words, whose score is the bias alone. Repeated rows get equal scores; repeated labels of an id count
    as 1 if any is; with labels of one kind only, or none, every text scores what their share says.
    Other columns play no part; an empty table gives an empty result. Samples and rounds follow hashes
    and fixed seeds, so reruns agree.
    """
    model, prior = learn(docs, labels, ~held_out, id_col, text_col, label_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast((model, prior))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    out = rows.mapInArrow(lambda it: _score(it, *shared.value), "id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
