"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes meets a pattern, so equal passages are cut
alike wherever they stand. Digests of chunks are counted; a chunk that occurs more than once is
encoded once, and its ids are joined back to the texts that hold it. Only texts with such a chunk
are shuffled; the others are encoded where they lie.

A chunk's own encoding is not exact at its ends, where a token may reach across. It is exact
between its first and its last safe cut: a place where a visible ASCII character is followed by
a space. The pre-tokenizer's pattern has no match that goes from other characters into white
space, and its look-ahead only asks what follows a run of white space, so both sides of such
a place are encoded alike whatever stands on the other. Each join is therefore repaired by
encoding again from the last safe cut before it, going on over following chunks, until the first
safe cut behind it, where the chunk's own ids agree with those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key
from .minhash import FLAT_BYTES, _key_longs, bloom, flat_parts, key_long, may_hold, spans_for

WINDOW = 16
MEAN_CHUNK = 512
LEAST_CHUNK = 64
#: White space in a row that ``tiktoken`` is not given: its regex gives up above a million characters. What
#: Python takes for white space holds all that the pattern does.
LONG_SPACE = 200_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")


class Coder:
    """Encoder and decoder of a ``tokenizers`` file with byte-level BPE.

    The merges are run by ``tiktoken`` where the ids follow the order of the merges, which gives
    the same ids several times faster (the tests compare all code points); else, and for texts
    with ``LONG_SPACE`` white-space characters in a row, by ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        plain = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if plain or any(c.isspace() for s in self.special for c in s):
            raise ValueError(f"{path} has added tokens that reach over white space")
        # bytes stand for themselves where they are visible, the others from code point 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        assert set(to_byte) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.path, self._slow = path, None
        if ordered:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
            long_space = lambda text: len(text) >= LONG_SPACE and _LONG_SPACE.search(text)
            self.encode = lambda text: self._library(text) if long_space(text) else fast.encode(text, allowed_special="all")
            self.decode = lambda ids: fast.decode(ids, errors="replace")
        else:
            self.encode = self._library
            self.decode = lambda ids: self._tokenizer().decode(ids, skip_special_tokens=False)

    def _tokenizer(self):
        """The file's own library, loaded when it is first needed."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return self._slow

    def _library(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids


def cuts(contents: list[bytes]) -> list[list[int]]:
    """Chunk borders of each item, its begin and end included; borders stand between characters."""
    line = b"".join(contents)
    if not line:
        return [[0, 0] for _ in contents]
    data = np.frombuffer(line, dtype=np.uint8)
    spans = spans_for(len(data))
    sums = spans.sums(data)
    at = np.arange(WINDOW, len(data))
    h = (sums[at] - sums[at - WINDOW]) * spans.down[at - WINDOW]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    hit = at[(h >> np.uint64(64 - MEAN_CHUNK.bit_length() + 1) == 0) & ((data[at] & 0xC0) != 0x80)]
    out, begin = [], 0
    for c in contents:
        end = begin + len(c)
        own = hit[np.searchsorted(hit, begin + WINDOW) : np.searchsorted(hit, end)] - begin
        borders = [0]
        for p in own.tolist():
            if p - borders[-1] >= LEAST_CHUNK:
                borders.append(p)
        out.append([*borders, len(c)])
        begin = end
    return out


def safe_range(chunk: bytes) -> tuple[int, int] | None:
    """First and last safe cut of a chunk, if it has two."""
    data = np.frombuffer(chunk, dtype=np.uint8)
    ok = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    return (int(ok[0]), int(ok[-1])) if len(ok) > 1 else None


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Item, place, content and digest of every chunk."""
    for a, b in flat_parts(texts):
        for i, borders in enumerate(cuts(texts[a:b]), a):
            for p, q in zip(borders, borders[1:], strict=False):
                if q > p:
                    c = texts[i][p:q]
                    yield i, p, c, hashlib.blake2b(c, digest_size=16).digest()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` (``FLAT_BYTES``) bytes of ``column`` (no nulls). Chunks and ids take a dozen times the
    memory of their text, so a worker holds them for a piece at a time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            held = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, held + (size or FLAT_BYTES), side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def assemble(text: bytes, hits: list[tuple[int, int, list[int]]], coder: Coder) -> list[int]:
    """Ids of a text from the exact middles of known chunks (begin, end, ids); what lies between
    them, the joins included, is encoded again."""
    ids: list[int] = []
    at = 0
    for begin, end, known in sorted(hits):
        if begin < at:
            continue
        if begin > at:
            ids += coder.encode(text[at:begin].decode("utf-8"))
        ids += known
        at = end
    if at < len(text):
        ids += coder.encode(text[at:].decode("utf-8"))
    return ids


_HIT = "array<struct<begin:int,end:int,ids:binary>>"


def _encoded(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """``finish(coder)(id, text, ids)`` of every row of ``docs`` (``id, text``)."""
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))

    def raw(batch):
        return [t.encode("utf-8") for t in batch.column("text").to_pylist()]

    def digests(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for *_, d in chunks(raw(batch))], pa.binary())], names=["c"])

    shared = docs.select("text").mapInArrow(digests, "c binary").groupBy("c").count().filter("count > 1")
    known = spark.sparkContext.broadcast(bloom(shared, key_long(F.col("c"))))

    def held(texts):
        """Chunks that may be shared; the filter lets some others pass, which does no harm."""
        found = list(chunks(texts))
        ok = may_hold(known.value, _key_longs([d for *_, d in found])) if found else []
        return [x for x, keep in zip(found, ok, strict=True) if keep]

    def contents(batches):
        sent: set[bytes] = set()
        for batch in slices(batches):
            out = []
            for _, _, c, d in held(raw(batch)):
                if d not in sent:
                    sent.add(d)
                    out.append((d, c))
            if len(sent) > 500_000:
                sent.clear()
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in cols], names=["c", "content"])

    def encode_once(batches):
        coder = Coder(path)
        for batch in slices(batches, "content"):
            out = []
            for d, c in zip(batch.column("c").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if found := safe_range(c):
                    a, b = found
                    out.append((d, a, b, np.array(coder.encode(c[a:b].decode("utf-8")), dtype=coder.dtype).tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["c", "a", "b", "ids"])

    once = docs.select("text").mapInArrow(contents, "c binary, content binary").groupBy("c").agg(F.first("content").alias("content"))
    codes = stored(once.mapInArrow(encode_once, "c binary, a int, b int, ids binary"), "codes")

    def places(batches):
        for batch in slices(batches):
            keys, out = batch.column("d").to_pylist(), []
            for i, p, _, d in held(raw(batch)):
                out.append((keys[i], p, d))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["d", "p", "c"])

    keyed = docs.withColumn("d", text_key(F.col("text")))
    # copies of a text name the same places: one of each is left before anything is gathered
    spots = keyed.select("text", "d").mapInArrow(places, "d binary, p int, c binary").distinct()
    hit = F.struct((F.col("p") + F.col("a")).alias("begin"), (F.col("p") + F.col("b")).alias("end"), "ids")
    hits = spots.join(codes, "c").groupBy("d").agg(F.collect_list(hit).alias("hits"))

    def alone(batches):
        """Rows whose texts hold no chunk that may be shared, encoded where they lie."""
        coder = Coder(path)
        row = finish(coder)
        for batch in slices(batches):
            texts = raw(batch)
            joined = {i for i, *_ in held(texts)}
            ids = batch.column("id").to_pylist()
            yield from row([(ids[i], t, coder.encode(t.decode("utf-8"))) for i, t in enumerate(texts) if i not in joined])

    def with_others(batches):
        for batch in slices(batches):
            yield batch.take(pa.array(sorted({i for i, *_ in held(raw(batch))}), pa.int64()))

    def joined(batches):
        coder = Coder(path)
        row = finish(coder)
        for batch in slices(batches):
            out = []
            for i, t, h in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "hits")), strict=True):
                t = t.encode("utf-8")
                known = [(x["begin"], x["end"], np.frombuffer(x["ids"], dtype=coder.dtype).tolist()) for x in h or []]
                out.append((i, t, assemble(t, known, coder)))
            yield from row(out)

    others = keyed.mapInArrow(with_others, keyed.schema).join(hits, "d", "left").select("id", "text", "hits")
    return docs.mapInArrow(alone, schema).unionByName(others.mapInArrow(joined, schema))


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` of every row: the whole text's ids (see ``encode_digests`` for the cases)."""

    def finish(coder):
        def row(rows):
            cols = list(zip(*((i, ids) for i, _, ids in rows), strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32()))], names=["id", "ids"])

        return row

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _encoded(rows, path, finish, "id long, ids array<int>").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row: digests of the whole text's ids
    (decimal, joined by commas) and of the text decoded from them.

    A null text counts as empty (no ids). Strings of special tokens in a text become their ids, as
    the file's own library has it. Null and repeated ids stay row by row; an empty table gives an
    empty result; other columns play no part. ``path`` names the tokenizer's file on every executor.
    """

    def finish(coder):
        digits = [str(i) for i in range(coder.size)]

        def row(rows):
            ids, n, a, b = [], [], [], []
            for i, _, tokens in rows:
                ids.append(i)
                n.append(len(tokens))
                a.append(hashlib.sha256(",".join(map(digits.__getitem__, tokens)).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(tokens).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return row

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(rows, path, finish, schema).withColumnRenamed("id", id_col)
