"""BPE with chunk reuse, and the Re-Pair token store, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import documents, frame, ordered, passage
from tokenizers import Tokenizer

from llm import bpe, tokenstore
from llm.bpe import Coder, assemble, chunks, encode_digests, encode_ids, safe_range
from llm.tokenstore import Pieces, decode_range, expand, expansion_lengths, read_documents, repair, write_tokens
from meterline.session import scratch_path

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def digest_row(plain, i, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    back = plain.decode(ids, skip_special_tokens=False)
    return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_coder_equals_the_library_on_all_code_points(plain):
    coder = Coder(BYTE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in points]
    assert [coder.encode(t) for t in texts] == [e.ids for e in plain[0].encode_batch_fast(texts, add_special_tokens=False)]


def test_coder_equals_the_library_on_the_other_code_points(plain):
    coder = Coder(BYTE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    del points[::7]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in points]
    assert all(coder.encode(t) == e.ids for t, e in zip(texts, plain[0].encode_batch_fast(texts, add_special_tokens=False), strict=True))


def test_very_long_white_space(spark, plain):
    texts = ["a b" + " " * 1_100_000 + "c<|endoftext|> d", "\n" * 1_100_000, "x " * 150_000 + "\u3000\t" * 600_000 + "'s"]
    coder = Coder(BYTE)
    assert [coder.encode(t) for t in texts] == [plain[0].encode(t, add_special_tokens=False).ids for t in texts]
    got = encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE)
    assert ordered(got.collect()) == ordered(digest_row(plain[0], i, t) for i, t in enumerate(texts))


def test_assembled_ids_are_exact_for_any_known_chunks(plain):
    rng, coder = random.Random(3), Coder(BYTE)
    bits = [" ", "\n", "  ", "'s", "'LL", "ab", "é", "1", "<|endoftext|>", "<|endof", "漢", " ", ".", "!!", "\r\n", "　", " the", " and"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(1500)).encode()
        hits = []
        for _, p, c, _ in chunks([text]):
            if (found := safe_range(c)) and rng.random() < 0.7:
                a, b = found
                hits.append((p + a, p + b, coder.encode(c[a:b].decode())))
        assert hits
        assert assemble(text, hits, coder) == plain[0].encode(text.decode(), add_special_tokens=False).ids


def test_chunks_cover_the_text_and_are_found_again(spark):
    rng = random.Random(4)
    shared = passage(rng, 600)
    a, b = (passage(rng, 50) + " " + shared + " " + passage(rng, n) for n in (5, 90))
    found = [[c for i, _, c, _ in chunks([a.encode(), b.encode()]) if i == j] for j in (0, 1)]
    assert b"".join(found[0]).decode() == a and b"".join(found[1]).decode() == b
    assert len(set(found[0]) & set(found[1])) >= 2


def test_documents_with_shared_passages(spark, plain):
    rng = random.Random(6)
    shared = passage(rng, 900)
    extra = [(100 + i, passage(rng, 30 * i) + " " + shared + passage(rng, 20), "en", "s0", 0, "", "", 0, 0.0, "") for i in range(4)]
    rows = documents() + extra
    got = encode_digests(frame(spark, rows), BYTE)
    assert ordered(got.collect()) == ordered(digest_row(plain[0], r[0], r[1]) for r in rows)
    ids = encode_ids(frame(spark, extra), BYTE).collect()
    assert {r[0]: r[1] for r in ids} == {r[0]: plain[0].encode(r[1], add_special_tokens=False).ids for r in extra}


def test_no_documents(spark):
    empty = frame(spark, []).limit(0)
    assert encode_digests(empty, BYTE).collect() == []
    path = scratch_path(spark, "tokens")
    write_tokens(empty, path, WORD, 1)
    assert read_documents(spark, path).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Coder(WORD)
    assert bpe.MEAN_CHUNK > bpe.LEAST_CHUNK > bpe.WINDOW


def test_work_is_done_on_slices_of_bounded_text():
    """All rows once and in order, in pieces of a bounded size but for longer texts."""
    texts = ["", "x" * bpe.FLAT_BYTES, "", "é" * bpe.FLAT_BYTES, *["y" * 1000] * 5000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = list(bpe.slices([batch, batch.slice(2, 3), batch.slice(0, 0)]))
    assert [i for b in got for i in b.column("id").to_pylist()] == [*range(len(texts)), 2, 3, 4]
    sizes = [sum(len(t.encode()) for t in b.column("text").to_pylist()) for b in got]
    assert max(s for s, b in zip(sizes, got, strict=True) if b.num_rows > 1) <= bpe.FLAT_BYTES and len(got) < 12


def test_a_task_holds_the_ids_of_a_slice_at_a_time(spark, plain, monkeypatch):
    """Of one batch of rows several come out, so never are all its ids held."""
    monkeypatch.setattr(bpe, "FLAT_BYTES", 300)
    rows = [(i, f"{i} some words of document {i}, no two of which are alike " * 2) for i in range(40)]

    def finish(coder):
        def row(rows):
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)] * len(rows), pa.int64())], names=["held"])

        return row

    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = [r.held for r in bpe._encoded(docs, BYTE, finish, "held long").collect()]
    assert len(got) == 40 and max(got) <= 3


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_token_store(spark, plain, block_ids):
    rows = documents()
    path = scratch_path(spark, "tokens")
    write_tokens(frame(spark, rows), path, WORD, 1, block_ids=block_ids)
    got = [tuple(r) for r in read_documents(spark, path).collect()]
    want = []
    for r in rows:
        ids = plain[1].encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert ordered((i, n, c) for i, _, n, c in got) == ordered(want)
    at = 0
    key = lambda i: (i is not None, i or 0)
    by_start = sorted(got, key=lambda r: r[1])
    assert [key(r[0]) for r in by_start] == sorted(key(r[0]) for r in by_start)
    for _, start, n, _ in by_start:
        assert start == at
        at += n


def test_pieces_equal_the_library(plain):
    rng, coder = random.Random(8), Pieces(WORD)
    bits = [" ", "\n", "\t", "'s", "It'S", "é", "é", "Σ", "1", "<|endoftext|>", "漢", " ", ".", "!!", "\r\n", "\x1c", "ab", "́"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
    assert got == [e.ids for e in plain[1].encode_batch_fast(texts, add_special_tokens=False)]


def test_words_are_met_once_whatever_stands_around_them(plain):
    """Pieces with punctuation and capitals do not fill the table, and no batch of encodings is made."""
    coder = Pieces(WORD)
    coder.known.clear()
    coder.coder = None
    text = "Élan, élan. ÉLAN! (élan)\n\"it's\""
    assert np.frombuffer(coder.encode([text])[0], dtype=coder.dtype).tolist() == plain[1].encode(text, add_special_tokens=False).ids
    assert sorted(coder.known) == sorted(["élan", ",", ".", "!", "(", ")", '"', "it", "'s"])


def test_common_characters_equal_the_library(plain):
    coder, sides = Pieces(WORD), ["a", "1", "!", "'", " ", "'s"]
    texts = [f"{x}{chr(c)}{y}" for c in [*range(1, 0x600), *range(0x2000, 0x2100), 0x1E9E] for x in sides for y in sides]
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
    assert got == [e.ids for e in plain[1].encode_batch_fast(texts, add_special_tokens=False)]


def test_words_of_a_text_are_merged_at_once(plain):
    """Only pieces with uncommon characters, and words too long for it, are met one by one."""
    rng, coder = random.Random(9), Pieces(WORD)
    # the library's model stays out of use
    coder.coder = coder.model = None
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0xF7), *range(0x430, 0x450)]]
    bits = [" ", "\n", "'s", "'S", "'ll", "'", "''", "It's", "1", "23", ".", "!!", "-'t", "é", "É", "Ж", "Ā", "—"]
    words = [lambda: rng.choice(bits), lambda: "".join(rng.choices(letters[: rng.choice([3, 26, 99])], k=rng.randint(1, 12))), lambda: " "]
    texts = ["".join(rng.choice(words)() for _ in range(rng.randint(300, 900))) for _ in range(300)]
    vocab = plain[1].get_vocab()
    texts += [" ".join(t.removesuffix("</w>") for t in vocab if t.isascii() and "<|" not in t)]
    assert min(map(len, texts)) >= 200
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
    assert got == [plain[1].encode(t, add_special_tokens=False).ids for t in texts]
    assert not coder.known


def test_long_texts_equal_the_library(plain):
    coder, sides = Pieces(WORD), ["a", "1", "!", "'", " ", "'s"]
    texts = [" ".join(f"{x}{chr(c)}{y}" for x in sides for y in sides) + pad for c in [*range(1, 0x600), *range(0x2000, 0x2100)] for pad in [" pad" * 30]]
    texts += ["x" * 5000 + " word" * 60, "a'b " * 80 + "é" * 1001, "1" * 3000, " " * 3000, "\n" * 300 + "'s" * 300, "漢 is odd, " + "the rest is not, " * 20]
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
    assert got == [plain[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_words_of_several_texts_are_merged_once(plain):
    rng, coder, asked = random.Random(10), Pieces(WORD), []

    class Merger:
        def encode_to_numpy(self, line, **how):
            asked.append(line)
            return inner.encode_to_numpy(line, **how)

    inner, coder.merger = coder.merger, Merger()
    words = [passage(rng, 1) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
    assert got == [plain[1].encode(t, add_special_tokens=False).ids for t in texts]
    # a word may stand behind a blank, a line's end or another word
    different = {w for t in texts for w, _ in plain[1].pre_tokenizer.pre_tokenize_str(plain[1].normalizer.normalize_str(t))}
    assert len(asked) == 1 and asked[0].count("\x01") <= 3 * len(different)


def test_texts_of_all_kinds_in_one_call(plain):
    """Empty and blank texts, odd pieces, long words and the stand-ins themselves keep their places."""
    rng, coder = random.Random(11), Pieces(WORD)
    bits = ["", " ", "\n\n", " " * 1200, "漢字 and", "a\x01b", "\x02", "\x02 \x01", "<|endoftext|>", "it's", "IT'S 12", "x" * 1300, "é" * 1001 + "!", "𝒳 y", "word", "\t"]
    for n in (1, 2, 5, 60):
        for _ in range(40):
            texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(n)] + ["x" * 200]
            got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
            assert got == [plain[1].encode(t, add_special_tokens=False).ids for t in texts]
    for texts in (["漢 " * 300], [" " * 300], ["", " " * 300, ""], ["x" * 3000], ["\x02" + " " * 300]):
        got = [np.frombuffer(b, dtype=coder.dtype).tolist() for b in coder.encode(texts)]
        assert got == [plain[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_are_encoded_by_bounded_text(plain, monkeypatch):
    """A call gets rows up to a number of bytes, whatever their number."""
    monkeypatch.setattr(tokenstore, "SLICE_BYTES", 5000)
    held, encode = [], Pieces.encode
    monkeypatch.setattr(Pieces, "encode", lambda self, texts: held.append(sum(map(len, texts))) or encode(self, texts))
    texts = [f"text {i} " * (300 if i % 50 else 1) for i in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts), pa.array([0] * 100, pa.int32())], names=["id", "text", "part"])
    blocks = [b.to_pylist()[0] for b in tokenstore._blocks(iter([rows, rows.slice(0, 0)]), WORD, 1, 1 << 20)]
    assert sum(held) == sum(map(len, texts)) and max(held) <= 5000
    want = [plain[1].encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert len(blocks) == 1 and blocks[0]["ids"] == list(range(100)) and blocks[0]["sizes"] == list(map(len, want))
    symbols, rules, _ = tokenstore.unpack(blocks[0])
    assert expand(symbols, rules, blocks[0]["first"]).tolist() == sum(want, [])


def test_repair_of_equally_frequent_pairs_in_ascending_order():
    """Ties are not broken by the symbols: each pair would lose to the next one."""
    ids = np.tile(np.arange(1000), 40).astype("<u2")
    symbols, rules = repair(ids, 1000)
    assert (expand(symbols, rules, 1000) == ids).all() and len(symbols) + 2 * len(rules) < len(ids) / 4


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, [1, 2] * 300, list(range(50)) * 20, np.random.default_rng(1).integers(0, 9, 5000).tolist()])
def test_repair_round_trip_and_random_access(ids):
    ids = np.array(ids, dtype=np.uint32)
    symbols, rules = repair(ids, 100)
    assert (expand(symbols, rules, 100) == ids).all() and len(symbols) <= len(ids)
    if len(ids) >= 600:
        assert len(symbols) + 2 * len(rules) < len(ids)
    lengths = expansion_lengths(rules, 100)
    assert [len(expand(np.array([100 + i]), rules, 100)) for i in range(len(rules))] == lengths.tolist()
    block = {"first": 100, "width": 4, "symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.tobytes()}
    for begin in range(0, len(ids), 97):
        assert (decode_range(block, begin, min(begin + 31, len(ids))) == ids[begin : begin + 31]).all()
