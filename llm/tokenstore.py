"""Token ids on disk, compressed by Re-Pair grammars.

Documents are put in order of id over range partitions, encoded, and written in blocks of about
``BLOCK_IDS`` ids, each document followed by the end id. A block is one row of a Parquet table:

    part, block      place of the block in the order
    ids, sizes       the documents' ids and their numbers of token ids
    first            smallest nonterminal; smaller symbols are token ids
    width            bytes of a symbol in ``rules`` and ``symbols`` (2 or 4, little-endian)
    rules            left and right symbol of each nonterminal, in order
    lengths          ids that each nonterminal expands to (4 bytes, little-endian)
    symbols          the compressed sequence

Re-Pair replaces frequent pairs of neighbouring symbols by new nonterminals, round after round,
until a round no longer pays. The expansion lengths give the place of any id without decoding
what stands before it (``decode_range``).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices

BLOCK_IDS = 1 << 20
LEAST_COUNT = 4
LEAST_GAIN = 0.005
CACHED_WORDS = 500_000
SLICE_BYTES = 8 << 20  # of text that are encoded together; arrays take a dozen times that
SHORT_TEXT = 200  # characters: below, the arrays cost more than looking up each word
LONG_WORD = 1000  # characters: ``tiktoken`` may merge a word in time that grows with the square of its length
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
LETTER, DIGIT, OTHER = 1, 2, 3
WORD_END = "\x01"  # stands for the model's end-of-word suffix; not a common character
ODD_PIECE = "\x02"  # stands for a piece that goes to the library as it is; not a common character
# what ``Pieces`` splits itself; other files are left to the library piece by piece
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
# Basic Latin, Latin-1 and Extended-A and -B, Cyrillic, punctuation
COMMON_BLOCKS = range(0x21, 0x7F), range(0xA1, 0x250), range(0x400, 0x460), range(0x2010, 0x2060)

_BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("first", pa.int32()),
    ("width", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
])
_BLOCK_SQL = (
    "part int, block int, ids array<bigint>, sizes array<bigint>, first int, width int, rules binary, lengths binary, symbols binary"
)


class _Words(dict):
    """Packed ids by word; a word that is not known yet is encoded by ``coded``."""

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.coded(word)
        return ids


class Pieces:
    """Encoder of the ``tokenizers`` library that meets each word once.

    Exact where the file's pre-tokenizer drops white space and no added token holds any: blanks
    separate pieces that neither normalisation nor merges can join, which is checked on loading.
    Where the file splits words by ``SPLIT``, pieces of common characters are cut into words here: what is common is
    asked of the library on loading, character by character (``_common``). Texts are cut together, and ``tiktoken``
    runs the merges of their different words at once where that gives the model's own ids (``_merger``); else, for words
    above ``LONG_WORD`` and for texts below ``SHORT_TEXT`` characters in all, only new words go to the library's model.
    Pieces with any other character or an added token go to the library as they are. Words and pieces
    that the library has met are kept, up to ``CACHED_WORDS``. It is called
    for one word or piece at a time: its batches start threads and hold all their encodings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.size = self.coder.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        probe = ["a b", " a\n b ", "it's 10 b.", "a  ,b"]
        apart = all(self._ids(t) == sum((self._ids(p) for p in t.replace("\n", " ").split(" ")), []) for t in probe)
        if not apart or any(c.isspace() for t in added for c in t):
            raise ValueError(f"{path}: pieces between blanks are not encoded independently")
        self.known, self.model = _Words(), self.coder.model
        common, letters, self.image = self._common(path)
        self.known.coded = self._word
        self.odd = re.compile("|".join([f"[^ \\n{common}]", *map(re.escape, added)])) if common else re.compile("")
        self.added, self.latin = added, bytes(c for c in range(256) if common and not self.odd.match(chr(c)))
        self.words = re.compile(f"{CONTRACTION.pattern}|[{letters}]+|[0-9]|[^ \\n0-9{letters}]+").findall if common else None
        self.merger = self._merger(path) if common else None
        self.kinds = np.zeros(COMMON_BLOCKS[-1].stop, dtype=np.uint8)  # by code point; blanks stay 0
        for kind, chars in ((OTHER, [*self.image, ord(ODD_PIECE)]), (LETTER, map(ord, letters)), (DIGIT, range(48, 58))):
            self.kinds[list(chars)] = kind

    @classmethod
    def kept(cls, path: str) -> Pieces:
        """The encoder of this worker process."""
        # functions travel by value, so what outlives a task is kept with the interpreter
        held = sys.__dict__.setdefault("_token_pieces", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _common(self, path: str) -> tuple[str, str, dict[int, str]]:
        """Common characters and the letters among the lower-case ones, both for a regex, and the byte-level image
        of these. A character is common if the library lower-cases it as Python does and changes nothing else, and
        joins it to letters or to punctuation; all of them are if blanks are left out of account."""
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [(spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")]
        if steps != [NORMAL, SPLIT]:
            return "", "", {}
        normal, cut = self.coder.normalizer.normalize_str, self.coder.pre_tokenizer.pre_tokenize_str
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters, others = set(), set("0123456789")
        asked = [chr(c) for block in COMMON_BLOCKS for c in block]
        for c in asked:
            if c.lower() == c and normal(f"a{c}a") == f"a{c}a" and not unicodedata.combining(c) and c not in others:
                if len(cut(f"a{c}a")) == 1:
                    letters.add(c)
                elif len(cut(f"!{c}!")) == 1:
                    others.add(c)
        small = letters | others
        common = [c for c in asked if c in small or c.lower() in letters and normal(f"a{c}a") == f"a{c.lower()}a"]
        image = {ord(c): "".join(p for p, _ in mapped(c)) for c in small}
        return "".join(map(re.escape, common)), "".join(sorted(letters)), image

    def _merger(self, path: str):
        """The model's merges as a ``tiktoken`` encoding of words with ``WORD_END`` behind each, or None.

        ``tiktoken`` joins two neighbours if they make a token, the lowest id first, and takes a word that is a token
        whole. The model joins by rules. Both agree where the ids of joined tokens follow the rules, one rule a token,
        and every token's own text comes to that token: whenever two neighbours make a token, they then are what its text
        alone comes to before its last rule. Bytes with the suffix have the smallest ids but for single bytes, so they are joined first."""
        import tiktoken
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], spec.get("end_of_word_suffix")
        others = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if spec["type"] != "BPE" or not end or any(spec.get(k) for k in others):
            return None
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        # bytes stand for themselves where they are visible, the others from code point 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        single = {vocab.get(c) for c in to_byte} == set(range(256)) and {vocab.get(c + end) for c in to_byte} == set(range(256, 512))
        joined = [a.removesuffix(end) + b for a, b in rules] == [a + b for a, b in rules]
        if not (single and joined and len(vocab) == 512 + len(rules) and all(vocab.get(a + b) == 512 + i for i, (a, b) in enumerate(rules))):
            return None
        inner = models.BPE(vocab=vocab, merges=rules)
        for token, i in vocab.items():
            alone = self.model.tokenize(token.removesuffix(end)) if token.endswith(end) else inner.tokenize(token)
            if [t.id for t in alone] != [i]:
                return None
        ranks = {}
        for token, i in vocab.items():
            own = bytes(map(to_byte.__getitem__, token.removesuffix(end)))
            if WORD_END.encode() not in own:
                ranks[own + WORD_END.encode() * token.endswith(end)] = i
        ranks[WORD_END.encode()] = vocab[next(c for c, b in to_byte.items() if b == ord(WORD_END))]
        self.last = np.zeros(len(vocab), dtype=bool)  # by id: the token ends a word
        self.last[[i for token, i in vocab.items() if token.endswith(end)]] = True
        never = {2 * WORD_END: len(vocab)}  # an encoding without special tokens looks for the empty one
        return tiktoken.Encoding("words", pat_str=f"[^ \\n{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens=never)

    def _ids(self, text: str) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.translate(self.image)
        return np.array([t.id for t in self.model.tokenize(word)], dtype=self.dtype).tobytes()

    def _is_common(self, text: str) -> bool:
        if self.latin and not any(map(text.__contains__, self.added)):
            try:
                return not text.encode("latin-1").translate(None, self.latin)
            except UnicodeEncodeError:
                pass
        return not self.odd.search(text)

    def _packed(self, text: str) -> bytes:
        """Packed ids of a text, each word or piece by itself."""
        if self._is_common(text):
            return b"".join(map(self.known.__getitem__, self.words(text.lower())))
        out = []
        for piece in text.replace("\n", " ").split(" "):
            # no word holds what makes a piece odd, so both are told apart in one table
            out += [self._odd(piece)] if self.odd.search(piece) else map(self.known.__getitem__, self.words(piece.lower()))
        return b"".join(out)

    def _odd(self, piece: str) -> bytes:
        if piece not in self.known:
            self.known[piece] = np.array(self._ids(piece), dtype=self.dtype).tobytes()
        return self.known[piece]

    def _merge(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Packed ids of words in UTF-16, blanks before them included, by one call of ``tiktoken``."""
        if not len(words):
            return pa.array([], pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[1 : len(words) + 1] // 2
        codes = np.frombuffer(words.buffers()[2], dtype="<u2")[: ends[-1]]
        line = np.insert(codes, ends, ord(WORD_END)).tobytes().decode("utf-16-le")
        ids = self.merger.encode_to_numpy(line, disallowed_special=())
        return _binary(np.flatnonzero(self.last[ids]) + 1, ids.astype(self.dtype))

    def _merged(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are cut and merged together: of equal words one is merged."""
        lines, odd = [], []
        for text in texts:
            if not self._is_common(text):
                pieces = text.replace("\n", " ").split(" ")
                for i, piece in enumerate(pieces):
                    if self.odd.search(piece):
                        odd.append(piece)
                        pieces[i] = ODD_PIECE
                text = " ".join(pieces)
            lines.append(text.lower())
        line = "\n".join(lines)
        codes = np.frombuffer(line.encode("utf-16-le"), dtype="<u2")
        kind = np.append(self.kinds[codes], np.uint8(0))
        end = (kind[:-1] != 0) & ((kind[:-1] != kind[1:]) | (kind[:-1] == DIGIT))
        if "'" in line:
            # others take an apostrophe along; behind anything else it may begin a word of its own
            for m in CONTRACTION.finditer(line):
                if not m.start() or kind[m.start() - 1] != OTHER:
                    end[m.start()], end[m.end() - 1] = False, True
        at = np.flatnonzero(end) + 1
        if not len(at):
            return [b""] * len(texts)
        # a word takes along the blanks before it; long words and odd pieces are told apart as nulls
        aside = (np.diff(at, prepend=0) > LONG_WORD) | (codes[at - 1] == ord(ODD_PIECE))
        own = np.flatnonzero(aside)
        words = _binary(at, codes, ~aside if len(own) else None).dictionary_encode()
        coded, index = self._merge(words.dictionary), words.indices
        if len(own):
            pieces, begins = iter(odd), np.append(0, at)[own]
            alone = (line[a:b].strip(" \n") for a, b in zip(begins.tolist(), at[own].tolist(), strict=True))
            alone = [self._odd(next(pieces)) if word == ODD_PIECE else self.known[word] for word in alone]
            index = index.fill_null(0).to_numpy().copy()
            index[own] = len(coded) + np.arange(len(own))
            coded, index = pa.concat_arrays([coded, pa.array(alone, pa.large_binary())]), pa.array(index)
        out = coded.take(index)
        stops = np.cumsum([len(t) + 1 for t in lines]) - 1  # of each text in the line
        stops = np.frombuffer(out.buffers()[1], dtype=np.int64)[np.searchsorted(at, stops, side="right")].tolist()
        packed = memoryview(out.buffers()[2] or b"")
        return [bytes(packed[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed in ``dtype``."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if self.merger is None or sum(map(len, texts)) < SHORT_TEXT:
            return [self._packed(t) for t in texts]
        return self._merged(texts)


def _binary(ends: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.LargeBinaryArray:
    """Array of the pieces of ``values`` that end before ``ends``."""
    offsets, mask = np.append(0, ends) * values.itemsize, None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [mask, pa.py_buffer(offsets), pa.py_buffer(values)])


def repair(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (pairs) of a sequence of ids below ``first``.

    A round counts pairs in hash buckets. Of a bucket that is large enough one pair is counted exactly, the
    others wait for the next round, whose buckets differ. Every frequent pair is then replaced at
    once where it stands apart from a more frequent one. Pairs that are then replaced fewer than ``LEAST_COUNT`` times wait.
    A pair of old symbols never becomes more frequent, so rare ones are not looked at again.
    """
    seq, rules, new, turn = ids.astype(np.uint32), [], first, 0x9E3779B97F4A7C15
    at = np.arange(len(seq) - 1)  # places of the pairs that may be frequent
    while len(at):
        bins = 1 << max(12, int(len(at)).bit_length() - 1)  # larger ones leave the processor's caches
        # in place, and rows are taken by number: a mask that is half true costs more
        pair = seq[at].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= seq[at + 1]
        bucket = pair * np.uint64(turn)
        bucket >>= np.uint64(65 - bins.bit_length())
        bucket = bucket.view(np.int64)
        turn = turn * 0xD6E8FEB86659FD93 % (1 << 64)
        many = np.flatnonzero((np.bincount(bucket, minlength=bins) >= LEAST_COUNT)[bucket])
        at, pair, bucket = at[many], pair[many], bucket[many]
        counted = np.zeros(bins, dtype=np.uint64)
        counted[bucket] = pair
        own = counted[bucket] == pair
        count = np.bincount(bucket[np.flatnonzero(own)], minlength=bins)
        often = np.flatnonzero(count >= LEAST_COUNT)
        kinds = counted[often]
        order = np.sort(count[often] << 32 | np.arange(len(often))) & 0xFFFFFFFF
        kinds = kinds[order]
        # more frequent pairs win; among equals the one in the later bucket
        rank = np.zeros(bins, dtype=np.int32)
        rank[often[order]] = np.arange(1, len(kinds) + 1)
        here = rank[bucket]
        here *= own
        often = np.flatnonzero(here)
        left, here, at = at[np.flatnonzero(~own | (here > 0))], here[often], at[often]
        weight = np.zeros(len(seq) + 2, dtype=np.int32)  # by place + 1, with zeros at either end
        weight[at + 1] = here
        before = weight[at]
        win = (here >= before) & (here >= weight[at + 2])
        again = np.flatnonzero(here == before)
        if len(again):
            # a run of one id holds the same pair again and again: every other one counts
            number = np.arange(len(again))
            begin = np.maximum.accumulate(np.where(np.diff(again, prepend=-2) > 1, number, 0))
            win[again[(number - begin) % 2 == 0]] = False
        win = np.flatnonzero(win)
        good = np.bincount(here[win], minlength=len(kinds) + 1)[1:] >= LEAST_COUNT
        win = win[np.flatnonzero(good[here[win] - 1])]
        if len(win) < max(LEAST_COUNT, LEAST_GAIN * len(seq)):
            break
        spot = at[win]
        seq[spot] = (np.cumsum(good) - 1 + new)[here[win] - 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[spot + 1] = False
        keep = np.flatnonzero(keep)
        next_ = np.zeros(len(seq), dtype=bool)
        next_[left] = True
        next_[spot] = True
        next_ = next_[keep]
        place = spot - np.arange(len(spot))  # a replaced pair leaves one symbol
        next_[np.maximum(place - 1, 0)] = True
        seq = seq[keep]
        at = np.flatnonzero(next_[:-1])
        rules.append(np.stack([kinds[good] >> np.uint64(32), kinds[good] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        new += int(good.sum())
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of each nonterminal. Rules name earlier rules only."""
    out = np.zeros(len(rules), dtype=np.uint32)
    done = 0
    while done < len(rules):
        # all rules that name finished symbols only: those before the first that does not
        top = rules[done:].max(axis=1).astype(np.int64) - first
        late = np.flatnonzero(top >= done)
        end = done + int(late[0]) if len(late) else len(rules)
        part = rules[done:end].astype(np.int64) - first
        out[done:end] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(axis=1)
        done = end
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of a sequence of symbols."""
    if len(symbols) > len(rules) > 0:
        # each rule once, then all symbols from that
        lengths = expansion_lengths(rules, first).astype(np.int64)
        flat = np.concatenate([np.arange(first, dtype=np.uint32), _expand(np.arange(first, first + len(rules)), rules, first)])
        size = np.concatenate([np.ones(first, dtype=np.int64), lengths])
        start = np.cumsum(size) - size
        each = size[symbols]
        ends = np.cumsum(each)
        return flat[np.arange(ends[-1]) + np.repeat(start[symbols] - (ends - each), each)]
    return _expand(symbols, rules, first)


def _expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    seq = symbols.astype(np.uint32)
    while True:
        big = seq >= first
        if not big.any():
            return seq
        place = np.arange(len(seq)) + np.cumsum(big) - big
        out = np.empty(len(seq) + int(big.sum()), dtype=np.uint32)
        out[place] = seq
        pair = rules[seq[big].astype(np.int64) - first]
        out[place[big]], out[place[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def unpack(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths of a block row."""
    kind = f"<u{block['width']}"
    return np.frombuffer(block["symbols"], kind), np.frombuffer(block["rules"], kind).reshape(-1, 2), np.frombuffer(block["lengths"], "<u4")


def decode_range(block: dict, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block, expanding only the symbols that hold them."""
    symbols, rules, lengths = unpack(block)
    first = block["first"]
    each = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= first
    each[big] = lengths[symbols[big].astype(np.int64) - first]
    ends = np.cumsum(each)
    a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, first)[begin - skipped : end - skipped]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    coder = Pieces.kept(path)
    tail = np.array([end_id], dtype=coder.dtype).tobytes()
    ids, packed, held, block, part = [], [], 0, 0, 0

    def flush():
        seq = np.frombuffer(b"".join(packed), dtype=coder.dtype)
        symbols, rules = repair(seq, coder.size)
        kind = np.dtype("<u2") if coder.size + len(rules) <= 1 << 16 else np.dtype("<u4")
        lengths = expansion_lengths(rules, coder.size)
        row = [part, block, ids, [len(p) // coder.dtype.itemsize for p in packed], coder.size, kind.itemsize,
               rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

    for batch in slices(batches, size=SLICE_BYTES):
        part = batch.column("part")[0].as_py()
        for i, p in zip(batch.column("id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
            ids.append(i)
            packed.append(p + tail)
            held += len(packed[-1]) // coder.dtype.itemsize
            if held >= block_ids:
                yield flush()
                ids, packed, held, block = [], [], 0, block + 1
    if ids:
        yield flush()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
) -> None:
    """Encode whole texts and write them in ascending order of id (null first; among equal ids by
    a hash of the text, then the text). Null texts count as empty: the end id alone. Rows that repeat are
    written each for itself; an empty table writes no block; other columns play no part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    rows = rows.select("id", "text", F.spark_partition_id().alias("part"))
    blocks = rows.mapInArrow(lambda it: _blocks(it, tokenizer, end_id, block_ids), _BLOCK_SQL)
    blocks.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1).to_pylist()[0]
            symbols, rules, _ = unpack(block)
            ids = expand(symbols, rules, block["first"]).astype("<u4")
            ends = np.cumsum(block["sizes"], dtype=np.int64)
            starts = ends - block["sizes"]
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block["part"]] * n, pa.int32()), pa.array([block["block"]] * n, pa.int32()), pa.array(block["ids"], pa.int64()),
                 pa.array(starts), pa.array(block["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "block", "id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, decoded from the files; ``start`` counts
    the ids of all documents before it."""
    stored = spark.read.parquet(path)
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = stored.select("part", "block", total.alias("total"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part of the sort
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("total").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ahead"))
    blocks = sums.withColumn("inside", F.coalesce(F.sum("total").over(inner), F.lit(0))).join(parts, "part")
    blocks = blocks.select("part", "block", (F.col("inside") + F.col("ahead")).alias("ahead"))
    rows = stored.mapInArrow(_documents, "part int, block int, id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(blocks, ["part", "block"]).select("id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
