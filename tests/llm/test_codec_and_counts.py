import hashlib
import random

import pytest
from cellmesa.llm import bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PIECES = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", " ", "\x85", "<|endoftext|>", "<|startoftext|>", "1", "23", "'s", "'", "!", "Σ", "ς", "中", "　", "İ", "x" * 50, "\x00", "😀", "\r\n", "the. ", "Thing, "]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(n)]


def library(name):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


def test_codec_agrees_with_the_library_on_whole_texts():
    tok, codec = library("word_bpe_49k.json"), bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    shared = "one passage of many words that stands in several texts " * 200
    for text in [*texts(300, 1), shared, "x " + shared, shared + shared, "é" * 40_000, "a" * 40_000]:
        ids = tok.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids
        assert codec.decode(got) == tok.decode(ids, skip_special_tokens=False)
    assert codec.reused > 0 and codec.by_word


def test_joins_that_do_not_agree_are_widened_to_the_whole_text(monkeypatch):
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), word_bytes=2000, chunk_bytes=2000)
    text = "".join(f"word{i} and more, " for i in range(2000))
    want = codec.direct(text.encode())
    assert codec.encode(text) == want and codec.whole == 0
    right = codec.whole_words
    monkeypatch.setattr(codec, "whole_words", lambda raw: b"" if raw == b"" else right(raw) + b"\0\0\0\0")  # chunks that are wrong at their ends
    codec.chunks.clear()
    assert codec.encode(text) == want and codec.whole == 1 and codec.widened > 0


def test_caches_are_bounded_by_bytes():
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), word_bytes=100_000, chunk_bytes=100_000)
    merger = token_counts.RankMerger(public_tokenizers.path("byte_bpe_50k.json"), cache_bytes=100_000)
    for i in range(30):
        text = f"{i}" + "x" * 60_000 + " y"
        codec.encode(text)
        merger.counts([text])
    assert sum(map(len, codec.words)) < 300_000 and sum(map(len, merger.cache)) < 300_000 and sum(len(x[1]) for x in codec.chunks.values()) < 100_000


def test_codec_with_a_vocabulary_that_keeps_white_space():
    tok, codec = library("byte_bpe_50k.json"), bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not codec.by_word
    for text in texts(50, 2):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert codec.decode(codec.encode(text)) == tok.decode(ids, skip_special_tokens=False)


def test_cuts_follow_content():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(60_000)).encode()
    ends = set(bpe.cuts(body))
    moved = {e - 7 for e in bpe.cuts(b"1234567" + body)}
    assert len(ends & moved) > 0.8 * len(ends)
    assert max(bpe.cuts(body)) == len(body)


def test_codec_rows(spark):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 2), (1, 2), (3, 0)]
    assert {r.ids_sha256 for r in got if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_documents(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_counts_agree_with_the_library():
    tok, merger = library("byte_bpe_50k.json"), token_counts.RankMerger(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    many = [*texts(300, 4), *("".join(rng.choice("ab e") for _ in range(300)) for _ in range(40)), "aaaa" * 3000]
    assert merger.counts(many) == [len(tok.encode(t, add_special_tokens=False).ids) for t in many]


def test_count_rows(spark):
    rows = [(1, "Hello there", 5), (None, None, 6), (2, "", 7), (2, "é " * 2000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[(1, 11)] == (2, False) and got[(None, 0)] == (0, False) and got[(2, 0)] == (0, False)
    assert got[(2, 6000)][1]
    assert token_counts.count_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
