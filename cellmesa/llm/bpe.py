"""BPE encoding and decoding with chunks that documents share.

A rolling hash over a text's bytes sets the cuts, so equal passages fall into equal chunks wherever they stand. A task
encodes each distinct chunk once and keeps it in a cache of bounded bytes. A cut may fall inside a word, so the pieces at
each join are encoded again, in a window that takes in whole neighbours until a word lies on either side of it and whose
encoding must agree exactly with those of the chunks it overlaps. A window that does not agree is widened by more words,  up to both chunks, and at last the whole text is encoded at once.

Null and empty texts have no tokens. Repeated rows and rows without an id are encoded like any other; other columns of the
input play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes that the rolling hash sees; a power of two.
WINDOW = 16
#: A cut is where the hash's top bits are zero: one position in 2 ** CUT_BITS.
CUT_BITS = 11
LEAST, MOST = 256, 16384
_AFTER_SPACE = re.compile(rb"[ \n](?=[^ \t-\r])")


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()
#: Byte-level vocabularies show a byte as itself if it is printable in Latin-1, else as the next character from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 text; each is the start of a character, and the last is the text's end."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    h, width, base = _GEAR[data], 1, 0x2C9277B5
    while width < WINDOW:  # hash of 2w bytes = hash of the earlier w times base ** w, plus that of the later w
        wide = h.copy()
        wide[width:] += h[:-width] * np.uint32(base)
        h, width, base = wide, width * 2, base * base & 0xFFFFFFFF
    found = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for p in [*found.tolist(), n]:
        while p - last > MOST:
            q = last + MOST
            while raw[q] & 0xC0 == 0x80:
                q -= 1
            out.append(q)
            last = q
        if p == n and p > last or p < n and p - last >= LEAST and raw[p] & 0xC0 != 0x80:
            out.append(p)
            last = p
    return out


class Codec:
    """One task's encoder: word and chunk caches of bounded size above a tokenizers file.

    Chunks serve vocabularies whose pre-tokenizer drops white space, so that words are encoded alone; with any other file
    each text is encoded directly.
    """

    def __init__(self, path: str, word_bytes: int = 96 << 20, chunk_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.joins_by_space = self.tok.decoder is None
        self.pieces = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.words: dict[bytes, bytes] = {}
        self.word_room = self.most_word_bytes = word_bytes
        self.chunks: dict[bytes, tuple[int, bytes, int]] = {}
        self.room = chunk_bytes
        self.reused = self.encoded = self.widened = self.whole = 0
        self.by_word = self.direct(b"a b\n a") == self.direct(b"a") + self.direct(b"b") + self.direct(b"a") and not self.direct(b" ") and self.direct(b"A b.") == self.direct(b"a b") + self.direct(b".")
        tries = ("thing", "\u00c9t\u00e9", "stra\u00dfe", "e\u0144")
        self.letters_alone = self.by_word and all(self.letters(x) == self.direct(x.encode()) for x in tries)

    def direct(self, raw: bytes) -> bytes:
        return np.array(self.tok.encode_batch_fast([raw.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def whole_words(self, raw: bytes) -> bytes:
        """Ids of a text whose ends are ends of words."""
        parts = (raw if b"<|" in raw else raw.lower()).split()
        try:
            return b"".join(map(self.words.__getitem__, parts))
        except KeyError:
            if self.word_room < 0:
                self.words.clear()
                self.word_room = self.most_word_bytes
            new = [w for w in set(parts) if w not in self.words]
            ends = [w for w in new if w[-1] in b".,:;!?" and w[:-1].isalpha()]  # a letter and a mark never share a token
            self.learn({w for w in new if not (w[-1] in b".,:;!?" and w[:-1].isalpha())} | {w[:-1] for w in ends} | {w[-1:] for w in ends})
            for w in ends:
                self.words[w] = self.words[w[:-1]] + self.words[w[-1:]]
            self.word_room -= sum(150 + len(w) + len(self.words[w]) for w in new)
            return b"".join(map(self.words.__getitem__, parts))

    def learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            if w in self.words:
                continue
            text = w.decode("utf-8", "replace")
            if self.letters_alone and text.isalpha() and max(text) < "\u0250" and text.lower().isalpha():
                self.words[w] = self.letters(text)
            else:
                rest.append((w, text))
        for (w, _), e in zip(rest, self.tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def letters(self, text: str) -> bytes:
        """Ids of a word of Latin letters straight from the model, which is given bytes as the characters that stand for them."""
        shown = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().encode().decode("latin-1").translate(_SHOWN)
        ids = [x.id for x in self.tok.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, raw: bytes) -> tuple[int, bytes, int]:
        """(bytes before the body, its ids, bytes after it): the body reaches from the first to the last start of a word."""
        key = hashlib.blake2b(raw, digest_size=16).digest()
        if (got := self.chunks.get(key)) is not None:
            self.reused += 1
            return got
        self.encoded += 1
        first = _AFTER_SPACE.search(raw)
        if first is None or (end := _last_start(raw)) <= first.end():
            got = (len(raw), b"", 0)
        else:
            got = (first.end(), self.whole_words(raw[first.end() : end]), len(raw) - end)
        self.chunks[key] = got
        self.room -= 400 + len(got[1])
        while self.room < 0:
            self.room += 400 + len(self.chunks.pop(next(iter(self.chunks)))[1])
        return got

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        raw = (text or "").encode("utf-8", "replace")
        if not self.by_word:
            return self.direct(raw)
        bodies, at = [(0, 0, b"")], 0
        for end in cuts(raw):
            before, ids, after = self.chunk(raw[at:end])
            if at + before < end:  # else no word lies whole inside, and the join takes in the chunk
                bodies.append((at + before, end - after, ids))
            at = end
        bodies.append((at, at, b""))
        out: list[bytes] = []
        for left, right in zip(bodies, bodies[1:]):
            between = self.join(raw, left, right)
            if between is None:
                self.whole += 1
                return self.direct(raw)
            out += [between, right[2]]
        return b"".join(out)

    def join(self, raw: bytes, left: tuple[int, int, bytes], right: tuple[int, int, bytes]) -> bytes | None:
        """Ids of what lies between two bodies ``(start, end, ids)``: a window with words of each is encoded again and has to
        agree with both; it is widened until it does, and null if it never does."""
        middle = raw[left[1] : right[0]]
        if not middle.split():
            return b""
        for n in (1, 8, 64, -1):
            before, after = _last_words(raw[left[0] : left[1]], n), _first_words(raw[right[0] : right[1]], n)
            whole = self.direct(b" ".join((before, middle, after)))
            x, y = self.whole_words(before), self.whole_words(after)
            if left[2].endswith(x) and right[2].startswith(y) and whole.startswith(x) and whole.endswith(y) and len(whole) >= len(x) + len(y):
                return whole[len(x) : len(whole) - len(y)]
            self.widened += 1
        return None

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        got = np.frombuffer(ids, "<u4").tolist()
        if not self.joins_by_space:
            return self.tok.decode(got, skip_special_tokens=False)
        return " ".join(map(self.pieces.__getitem__, got))


def _first_words(raw: bytes, n: int) -> bytes:
    return b" ".join(raw.split(None, n)[:n] if n > 0 else raw.split())


def _last_words(raw: bytes, n: int) -> bytes:
    return b" ".join(raw.rsplit(None, n)[-n:] if n > 0 else raw.split())


def _last_start(raw: bytes) -> int:
    """Where the last word that follows a space starts; 0 if there is none."""
    at = len(raw)
    while at > 0:
        at = max(raw.rfind(b" ", 0, at), raw.rfind(b"\n", 0, at))
        if 0 <= at and at + 1 < len(raw) and raw[at + 1] not in b" \t\n\x0b\x0c\r":
            return at + 1
    return 0


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids binary][, decoded])`` for every row of ``docs``; no shuffle."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", decoded string" * decoded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            encoded = [codec.encode(t) for t in texts]
            back = [codec.decode(x) for x in encoded]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
            ]
            columns += [pa.array(encoded, pa.binary())] * ids + [pa.array(back, pa.string())] * decoded
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
