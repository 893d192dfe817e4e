"""Token counts of whole texts by rank-synchronous merging of byte-pair symbols in ragged numpy arrays.

A batch's distinct pre-tokens lie end to end in one array of symbols with one array of starts. Each round finds the lowest
merge rank of every pre-token, applies that pair at all its places in all pre-tokens at once, and drops pre-tokens that
have no pair left; what survives is counted. A cache of bounded bytes holds the counts of pre-tokens that were seen before.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows and rows without an id are counted like any other. Strings of
added tokens inside a text count as one token each, as in the tokenizers library by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies show each byte: itself if printable in Latin-1, else the next from 256 on."""
    shown, spare = [], 256
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 256 and b != 173:
            shown.append(chr(b))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


class RankMerger:
    """Counts of symbols for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind, model = told["pre_tokenizer"] or {}, told["model"]
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or told["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer or added leading space is supported")
        if model.get("ignore_merges") or model.get("dropout") or any(x.get(k) for x in told["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("whole-word tokens, dropout and added tokens that take in their surroundings are not supported")
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_characters()], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width = np.int64(len(vocab) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.added = [x["content"] for x in told["added_tokens"]]
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}
        self.room = self.most = cache_bytes

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        sym = self.of_byte[np.frombuffer(b"".join([words[i] for i in live]), np.uint8)]
        sizes = sizes[live]
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(sym), NEVER, np.int32)  # of the pair that a symbol and the next one make
        if len(sym):
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[starts + sizes - 1] = NEVER
        while len(live):
            low = np.minimum.reduceat(rank, starts)
            if (done := low == NEVER).any():
                out[live[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                sym, rank, live, low, sizes = sym[keep], rank[keep], live[~done], low[~done], sizes[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(live):
                    break
            hit = rank == np.repeat(low, sizes)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping places every second one, from the left
                new = np.empty(len(at), bool)
                new[0], new[1:] = True, np.diff(at) != 1
                first = np.flatnonzero(new)
                nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[nth % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            owner = np.searchsorted(starts, at, side="right") - 1
            last = at + 1 == (starts + sizes - 1)[owner]  # the pair was its word's end
            at_new = at - np.arange(len(at))  # places after the right halves have gone
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            starts = np.cumsum(sizes) - sizes
            sym, rank = sym[~gone], rank[~gone]
            rank[at_new[last]] = NEVER
            inner = at_new[~last]
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            before = at_new[at_new > starts[owner]] - 1
            rank[before] = self.ranks(sym[before], sym[before + 1])
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        split, plus = [], []
        for text in texts:
            parts = [text or ""]
            if self.split_added and any(x in parts[0] for x in self.added):
                parts = self.split_added.split(parts[0])
            plus.append(len(parts) - 1)
            split.append([w for p in parts for w in self.words.findall(p)] if len(parts) > 1 else self.words.findall(parts[0]))
        if self.room < 0:
            self.cache.clear()
            self.room = self.most
        new = [w for w in set().union(*split) if w not in self.cache]
        self.cache.update(zip(new, self.merge([w.encode() for w in new]).tolist(), strict=True))
        self.room -= sum(130 + len(w) for w in new)
        known = self.cache.__getitem__
        return [sum(map(known, words)) + n for words, n in zip(split, plus, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row; a map without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(path)
        for batch in slices(batches, 1, 4 << 20):
            texts = batch.column(1).to_pylist()
            n = np.array(merger.counts(texts), np.int64)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
