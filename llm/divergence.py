"""Source divergence audit: how far the words of each source are from those of its language.

Words are counted by length. In a task the words of a part of the texts are taken as spans of one
byte array: words of up to eight bytes are packed into one unsigned 64-bit word, those of up to
sixteen into two (big-endian, padded with zeros, which no word holds, so packing loses nothing),
brought in order by a radix sort over 16-bit digits and counted as runs. Longer words are sorted
as bytes in buckets of like length. Packed words are what Spark adds up and shuffles; they become
text again only where they are kept.

Distances between all sources of a language need each kept word's probability in both, also where
the count is 0. The kept words of a language are dealt out by hash to cells of about
``TERMS_A_CELL`` words and two blocks of at most ``SOURCES_A_BLOCK`` sources or so; a cell holds a
small dense table and sends one partial sum for each pair of sources, never a row for each word
and pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
PART_BYTES = 8 << 20
TERMS_A_CELL = 2048
SOURCES_A_BLOCK = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_TERM = np.array([b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 for b in range(256)])
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_COUNTS = "lang string, source string, a long, b long, rest binary, n long, docs long"
_PAIR = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("f", pa.int64()), ("seen", pa.int64()),
    ("n_source", pa.int64()), ("n_other", pa.int64()), ("v", pa.int64()),
])


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned 64-bit words, the first the most significant: 16-bit digits
    from the last to the first, each by numpy's stable sort of 16-bit numbers, which is a radix sort."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs begin, how many words and how many documents each has; ``doc`` ascends in a run."""
    begins = np.flatnonzero(new)
    first_of_doc = new.copy()
    first_of_doc[1:] |= doc[1:] != doc[:-1]
    return begins, np.diff(np.append(begins, len(new))), np.add.reduceat(first_of_doc.astype(np.int64), begins)


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def count_runs(raws: list[bytes], group: np.ndarray) -> Iterator[tuple]:
    """``group, a, b, rest, n, docs`` as arrays, for texts that stand in the order of their groups.

    ``rest`` is a list of the words themselves (long words) or None (packed words)."""
    line = b"\n".join(raws).translate(_LOWER) + b"\n" + bytes(16)
    data = np.frombuffer(line, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_IS_TERM[data].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    length = ends - starts
    size = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1
    doc = np.searchsorted(np.cumsum(size), starts, side="right")
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=line, strides=(1,))  # the eight bytes from each place on

    def packed(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        keep = np.clip(left, 0, 8).astype(np.uint64)
        cut = (np.uint64(8) - keep) * np.uint64(8)
        words = eight[np.minimum(at, len(eight) - 1)].astype(np.uint64)
        return np.where(keep == 0, np.uint64(0), words >> np.minimum(cut, np.uint64(56)) << np.minimum(cut, np.uint64(56)))

    for low, high in ((1, 8), (9, 16)):
        some = np.flatnonzero((length >= low) & (length <= high))
        if not len(some):
            continue
        words = [packed(starts[some], length[some])]
        if high == 16:
            words.append(packed(starts[some] + 8, length[some] - 8))
        order = radix_order(words)
        words, d = [w[order] for w in words], doc[some][order]
        g = group[d]
        begins, n, docs = _runs(_changes(*words, g), d)
        b = words[1][begins] if high == 16 else np.zeros(len(begins), dtype=np.uint64)
        yield g[begins], words[0][begins].view(np.int64), b.view(np.int64), None, n, docs

    longest, width = int(length.max(initial=0)), 32
    while width // 2 < longest:
        some = np.flatnonzero((length > width // 2) & (length <= width))
        if len(some):
            table = np.empty((len(some), width // 8), dtype=">u8")
            for k in range(width // 8):
                table[:, k] = packed(starts[some] + 8 * k, length[some] - 8 * k)
            words = table.view(f"S{width}").reshape(-1)
            order = np.argsort(words, kind="stable")
            words, d = words[order], doc[some][order]
            g = group[d]
            begins, n, docs = _runs(_changes(words, g), d)
            zero = np.zeros(len(begins), dtype=np.int64)
            yield g[begins], zero, zero, words[begins].tolist(), n, docs
        width *= 2


def _pieces(raw: bytes) -> list[bytes]:
    """A text cut between words into pieces of about ``PART_BYTES``."""
    out, at = [], 0
    while len(raw) - at > PART_BYTES and (cut := _BREAK.search(raw, at + PART_BYTES)):
        out.append(raw[at : cut.start()])
        at = cut.start()
    return [*out, raw[at:]]


def _one_text(raw: bytes) -> Iterator[tuple]:
    """``count_runs`` of one very long text: its pieces are counted one by one and added up."""
    total: dict[tuple, int] = {}
    for piece in _pieces(raw):
        for _, a, b, rest, n, _ in count_runs([piece], np.zeros(1, dtype=np.int64)):
            for key, m in zip(zip(a.tolist(), b.tolist(), rest or [None] * len(a), strict=True), n.tolist(), strict=True):
                total[key] = total.get(key, 0) + m
    if total:
        a, b, rest = zip(*total, strict=True)
        ones = np.ones(len(a), dtype=np.int64)
        yield np.zeros(len(a), dtype=np.int64), np.array(a), np.array(b), list(rest), np.array(list(total.values())), ones


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[tuple[str, str], bytes]] = []

    def out(found: Iterator[tuple], names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(x, pa.string()) for x in zip(*names, strict=True))
        for g, a, b, rest, n, docs in found:
            at = pa.array(g)
            words = pa.nulls(len(g), pa.binary()) if rest is None else pa.array(rest, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [langs.take(at), sources.take(at), pa.array(a), pa.array(b), words, pa.array(n.astype(np.int64)), pa.array(docs)],
                names=["lang", "source", "a", "b", "rest", "n", "docs"],
            )

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            held.sort(key=lambda x: x[0])
            names = sorted({k for k, _ in held})
            number = {k: i for i, k in enumerate(names)}
            yield from out(count_runs([raw for _, raw in held], np.array([number[k] for k, _ in held])), names)
            held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            raw = text.encode("utf-8")
            if len(raw) > PART_BYTES:
                yield from out(_one_text(raw), [(lang, source)])
                continue
            if size + len(raw) > PART_BYTES:
                yield from flush()
                size = 0
            held.append(((lang, source), raw))
            size += len(raw) + 1
    yield from flush()


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, source, a, b, rest, n, docs`` of ``lang, source, text`` (no nulls): occurrences and
    documents of each word in each group; ``a, b`` pack a word of up to 16 bytes, ``rest`` is a longer one."""
    found = rows.select("lang", "source", "text").mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "source", "a", "b", "rest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def unpacked(a: Column, b: Column, rest: Column) -> Column:
    """The word as text. A word never begins with a byte below 0x61, so ``hex`` gives all its digits."""
    second = F.when(b == 0, F.lit("")).otherwise(F.hex(b))
    short = F.rtrim(F.unhex(F.concat(F.hex(a), second)).cast("string"), F.lit("\x00"))
    return F.when(rest.isNull(), short).otherwise(rest.cast("string"))


def share(count: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))``, exact beyond 64 bits; null if nothing is kept."""
    wide = "DECIMAL(25,0)"
    return F.expr(
        f"CASE WHEN {kept} > 0 THEN 1 + (CAST({count} + 2 AS {wide}) * {SCALE}BD) div (CAST({total} AS {wide}) + 2 * CAST({kept} AS {wide})) END"
    )


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``share``, in two steps of 64 bits: totals up to 9 * 10^13 words."""
    first, left = np.divmod((count + 2) * 100_000, total)
    return 1 + first * 10_000 + left * 10_000 // total


def _cell(table: pa.Table) -> pa.Table:
    """Partial sums of a cell for each pair of sources, the smaller name first."""
    lang, i, j, v = (table.column(c)[0].as_py() for c in ("lang", "i", "j", "v"))
    heads = table.filter(pc.is_null(table.column("term")))
    rows = table.filter(pc.is_valid(table.column("term")))
    names = heads.column("source").to_pylist()
    number = {s: k for k, s in enumerate(names)}
    block = heads.column("block").to_numpy()
    total = heads.column("total").to_numpy()
    terms = rows.column("term").combine_chunks().dictionary_encode()
    at = terms.indices.to_numpy(zero_copy_only=False)
    seen = len(terms.dictionary)
    count = np.zeros((len(names), seen), dtype=np.int64)
    own = [number[s] for s in rows.column("source").to_pylist()]
    count[own, at] = rows.column("n").to_numpy()
    p = _shares(count, (total + 2 * v)[:, None]) if v else count
    found: list[tuple] = []
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left.tolist():
        others = right[right > x] if i == j else right
        if not len(others):
            continue
        apart = p[x][None, :] - p[others]
        f = (apart * apart // np.maximum(p[x][None, :] + p[others], 1)).sum(axis=1)
        for y, value in zip(others.tolist(), f.tolist(), strict=True):
            a, b = (x, y) if names[x].encode() < names[y].encode() else (y, x)
            found.append((lang, names[a], names[b], value, seen, int(total[a]), int(total[b]), v))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(_PAIR), _PAIR, strict=True)], schema=_PAIR)


def _pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two sources of a language, both ways."""
    # one row for each language
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    cells = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / TERMS_A_CELL))
    blocks = F.ceil(F.col("sources") / SOURCES_A_BLOCK)
    sized = groups.join(langs, "lang").select(
        "lang", "source", "total", "v", cells.alias("cells"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block")
    )
    heads = sized.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
    words = kept.select("lang", "source", "term", "n").join(sized, ["lang", "source"])
    words = words.withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")))
    columns = ["lang", "source", "total", "v", "block", "blocks", "cell", "term", "n"]
    both = heads.select(*columns).unionByName(words.select(*columns))
    both = both.withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    both = both.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks")
    sums = both.groupBy("lang", "cell", "i", "j").applyInArrow(_cell, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _PAIR))
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"), *[F.max(c).alias(c) for c in ("n_source", "n_other", "v")])
    # words that neither source has
    zero = sums.withColumns({"p": share("0L", "n_source", "v"), "q": share("0L", "n_other", "v")})
    value = F.coalesce(F.col("f") + (F.col("v") - F.col("seen")) * gap("p", "q"), F.lit(0)).cast("long")
    ways = F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    return zero.select("lang", value.alias("value"), F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of language and source that occurs.

    A word (letters and all characters beyond ASCII, only A-Z lower-cased) is kept in a language if at
    least ``least_docs`` of its rows hold it. A group gives a kept word the probability
    ``p = 1 + floor(10^9 * (count + 2) / (N + 2V))``, N its kept occurrences, V the language's kept words.
    Part ``pair`` has for each other source of the language the sum of ``floor((p - q)^2 / (p + q))`` over
    all kept words (0 if none is kept), all ranks; part ``term`` the words that the group uses more than
    its language, ranks to ``top_terms``. Ranks count from 1 by falling value, then by the item's UTF-8.

    Null text, language and source count as empty text; repeated rows count one by one; a language with
    one source has no pairs; a table without rows gives none. Very long texts are counted in pieces.
    Other columns play no part. Whole numbers only, exact up to 9 * 10^13 words in a group.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(clean(lang_col).alias("lang"), clean(source_col).alias("source"), clean(text_col).alias("text"))
    of_term = Window.partitionBy("lang", "a", "b", "rest")
    counted = term_counts(rows).withColumns({
        "in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": F.min("source").over(of_term),
    })
    kept = counted.filter(F.col("in_docs") >= least_docs).select(
        "lang", "source", unpacked(F.col("a"), F.col("b"), F.col("rest")).alias("term"), "n", "n_lang", (F.col("source") == F.col("first")).alias("once")
    )
    kept = stored(kept, "kept-terms")
    whole = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("once").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "total_lang", "v"]), "groups")

    terms = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "v"), "q": share("n_lang", "total_lang", "v")})
    terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    of_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(of_source)).filter(F.col("rank") <= top_terms)
    pairs = _pairs(groups, kept).withColumn("rank", F.row_number().over(of_source))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", none).alias("value"), "rank")
    return pairs.unionByName(terms)
