"""N-gram Jaccard join: T-occurrence search over the shingle sets of whole texts.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets are one class, found by a grouped minimum; from here on a class
   is one document.
2. Families. A set is cut into parts by ranges of hashes, and linked sets agree on some part (``signatures``), so documents
   that share a signature meet in a family and no link leaves one. A signature takes several shingles at once, so a passage
   that many documents share brings few of them together. A task joins its own documents first and sends one posting for a
   signature. The signatures that start at a set's first parts meet first, a bounded number for each set; the rest are then
   posted for the families so found, as near copies share most signatures and would be joined anew in every task that some of
   them meet in. Families too large for one block are dealt again by signatures of more shingles.
3. Within a family, or a block of it where it is large, each document queries an inverted index of those before it:
   short lists are heap-merged, the L longest are probed by bisection (DivideSkip of Li, Lu and Lu 2008), and documents
   that reach the required overlap are linked. Documents already in the query's component need no search, and a component
   of many documents is first tried through one of them, so that a family of near copies takes linear time.
4. Links make components of classes, and each row takes its class's.

Shingles are told apart by 64-bit hashes. Null and empty texts have the empty set and link with nothing. Rows that share an
id are one document whose links are those of all its rows. Rows without an id are returned with a null component. Nothing is
broadcast but the classes with the most copies, at most four for each shuffle partition.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EDGES_AT_ONCE, components, dropped, forest, joined_by_class, runs, slices, small_batches, stored

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_ALL = (1 << 64) - 1
#: Shingles that make a part of a set a signature by itself.
STRONG = 2
#: Postings that a task gathers before it sends them, and bytes of postings that meet in a task at once.
FLUSH, PART_BYTES = 500_000, 8 << 20
#: The parts of a set that signatures start at which are posted first, and those of the rest.
FIRST, REST = range(8), range(8, 1 << 40)
#: Shingles that are signed at once.
SIGNED_AT_ONCE = 100_000
#: A block of a family holds so many documents and so many shingles, or one document.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class Shingler:
    """Shingle sets as sorted arrays of hashes; words' hashes are cached in ``room`` bytes and those of one text."""

    def __init__(self, words: int, room: int = 32 << 20):
        self.k, self.most, self.room, self.known = words, room, room, {}
        self.factors = mixed(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "replace").lower().split()
        n = len(parts)
        if not n:
            return np.empty(0, np.uint64)
        try:
            h = np.fromiter(map(self.known.__getitem__, parts), np.uint64, n)
        except KeyError:
            if self.room < 0:
                self.known.clear()
                self.room = self.most
            for w in set(parts):
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
                    self.room -= 150 + len(w)
            h = np.fromiter(map(self.known.__getitem__, parts), np.uint64, n)
        k = min(self.k, n)
        total = np.full(n - k + 1, k, np.uint64) * self.factors[-1]
        for j in range(k):
            total += mixed(h[j : n - k + 1 + j] * self.factors[j])
        out = mixed(total)
        out.sort()
        return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Bands:
    """Size bands. Band b holds sizes from edge b to below edge b + 2, so any two sizes that can link share a band."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges, self.told = num, den, [1], {}

    def of(self, size: int) -> list[int]:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, -(-self.edges[-1] * self.den // self.num)))
        base = next(i for i in range(len(self.edges) - 1, -1, -1) if self.edges[i] <= size)
        return [b for b in (base - 1, base) if b >= 0]

    def differ(self, b: int) -> int:
        """In how many shingles linked sets of a band may differ."""
        if b not in self.told:
            while len(self.edges) < b + 3:
                self.of(self.edges[-1])
            self.told[b] = 2 * (self.edges[b + 2] - 1) * (self.den - self.num) // (self.den + self.num)
        return self.told[b]


def signatures(sets: list[np.ndarray], bands: Bands, strong: int, starts: range = range(1 << 40)) -> tuple[np.ndarray, np.ndarray]:
    """(which set, key) of every signature of the sets that starts at a part in ``starts``; of all signatures, sets that link
    share one or are equal.

    In a band where linked sets differ in H shingles at most, the range of hashes has H + 1 parts, dealt around a ring. Of the
    differences, fewer than l lie in the first l parts that follow some start, for every l (the pigeonring of Qin and Xiao
    2018). So the pair agrees on the part at that start, and a part of ``strong`` shingles or more is a signature by itself. A
    smaller part goes together with the next one, of which one shingle may be left out, and if that is still too small with
    the one after that, of which as many may be left out as then differ at most; and so on.
    """
    which, keys = [], []
    sizes = np.array([len(x) for x in sets], np.int64)
    own_bands = [bands.of(int(n)) if n else [] for n in sizes]
    for turn in range(2):
        picked = [i for i, x in enumerate(own_bands) if len(x) > turn and bands.differ(x[turn])]
        if not picked:
            continue
        tokens = np.concatenate([sets[i] for i in picked])
        n = sizes[picked]
        band = np.array([own_bands[i][turn] for i in picked], np.uint64)
        parts = np.array([bands.differ(own_bands[i][turn]) + 1 for i in picked], np.int64)
        base = np.cumsum(parts) - parts  # each set's first part among those of all sets
        owner = np.repeat(np.arange(len(picked)), n)
        at = base[owner] + (((tokens >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        own = mixed(tokens + np.uint64(0x7654321))
        count = np.bincount(at, minlength=int(parts.sum()))
        first = np.cumsum(count) - count
        sums = np.zeros(len(count), np.uint64)
        full = np.flatnonzero(count)
        sums[full] = np.add.reduceat(own, first[full])
        of_part = np.repeat(np.arange(len(picked)), parts)
        ring = np.arange(len(count)) - base[of_part]
        name = mixed((ring.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + band[of_part])
        asked = (ring >= starts.start) & (ring < starts.stop)
        big = np.flatnonzero(asked & (count >= strong))
        found_at, found = [big], [mixed(sums[big] ^ name[big])]
        weak = np.flatnonzero(asked & (count < strong))
        after = base[of_part[weak]] + (ring[weak] + 1) % parts[of_part[weak]]
        # the next part whole, or without one of its shingles
        choices = 1 + count[after]
        start, follow = np.repeat(weak, choices), np.repeat(after, choices)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(choices) - choices, choices) - 1
        left = np.zeros(len(start), np.uint64)
        out = nth >= 0
        left[out] = own[first[follow[out]] + nth[out]]
        total, held = sums[start] + sums[follow] - left, count[start] + count[follow] - out
        done = (held >= strong) | (parts[of_part[start]] == 2)
        step = np.uint64(0x632BE59BD9B4E019)
        found_at.append(start[done])
        found.append(mixed(total[done] ^ mixed(name[start[done]] + step)))
        for s, x, h, gone in zip(start[~done].tolist(), total[~done].tolist(), held[~done].tolist(), out[~done].tolist(), strict=True):
            far, from_, n_parts = [], int(base[of_part[s]]), int(parts[of_part[s]])
            open_ = [(2, x, h, int(gone))]
            while open_:
                length, x, h, gone = open_.pop()
                p = from_ + (s - from_ + length) % n_parts
                mine = own[first[p] : first[p] + count[p]].tolist()
                for k in range(min(length - gone, len(mine)) + 1):
                    for less in combinations(mine, k):
                        y, m = (x + int(sums[p]) - sum(less)) & _ALL, h + len(mine) - k
                        if m >= strong or length + 1 == n_parts:
                            far.append((y ^ int(mixed(name[s : s + 1] + np.full(1, length, np.uint64) * step)[0])) & _ALL)
                        else:
                            open_.append((length + 1, y, m, gone + k))
            found_at.append(np.full(len(far), s))
            found.append(mixed(np.array(far, np.uint64)))
        which.append(np.array(picked, np.int64)[of_part[np.concatenate(found_at)]])
        keys.append(np.concatenate(found))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(which), np.concatenate(keys)


def postings(docs: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, keys, documents) to send for signatures ``keys`` of ``docs``: documents that share one here become an edge
    (a negative part: pairs of documents), and the smallest of those so joined stands for them elsewhere."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    met = np.flatnonzero(~new)
    u, v = forest(docs[met], docs[met - 1])
    keys, docs = keys[new], docs[new]
    if len(u):
        yield -1 - int(v[0]) % parts, u.tobytes(), v.tobytes()
        at = np.minimum(np.searchsorted(u, docs), len(u) - 1)
        docs = np.where(u[at] == docs, v[at], docs)
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # grows with the key
    by_doc = np.lexsort((docs, part))
    keys, docs, part = keys[by_doc], docs[by_doc], part[by_doc]
    ends = np.searchsorted(part, np.arange(parts + 1))
    for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        own = slice(ends[i], ends[i + 1])
        gaps = np.diff(docs[own], prepend=0)
        kind = next(t for t in (np.uint16, np.int32, np.int64) if np.iinfo(t).min <= gaps.min() and gaps[1:].max(initial=0) <= np.iinfo(t).max)
        lead = docs[own][:1].tobytes()
        yield i, keys[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), lead + gaps[1:].astype(kind).tobytes()


def met_in_part(keys: list[bytes], docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The edges of documents that share a key, from what ``postings`` has sent to a part."""
    sent = np.concatenate([np.frombuffer(k, np.uint8).reshape(-1, 6) for k in keys])
    key = np.zeros((len(sent), 8), np.uint8)
    key[:, :6] = sent
    del sent
    key = key.view("<u8").ravel()
    doc = []
    for k, d in zip(keys, docs, strict=True):
        n, size = len(k) // 6, len(d) - 8
        kind = {0: np.int64, 2 * (n - 1): np.uint16, 4 * (n - 1): np.int32}.get(size, np.int64)
        doc.append(np.cumsum(np.concatenate((np.frombuffer(d[:8], np.int64), np.frombuffer(d[8:], kind).astype(np.int64)))))
    doc = np.concatenate(doc)
    order = np.argsort(key, kind="stable")
    key = key[order]
    met = np.flatnonzero(key[1:] == key[:-1])
    return forest(doc[order[met]], doc[order[met + 1]])


class Poster:
    """Gathers signatures of sets and gives them away as ``postings`` when there are many."""

    def __init__(self, parts: int, bands: Bands, strong: int, starts: range):
        self.parts, self.bands, self.strong, self.starts = parts, bands, strong, starts
        self.docs: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, docs: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
        start = n = 0
        for i, tokens in enumerate(sets):  # some at a time, for what signing them takes
            n += len(tokens)
            if n < SIGNED_AT_ONCE and i + 1 < len(sets):
                continue
            which, keys = signatures(sets[start : i + 1], self.bands, self.strong, self.starts)
            self.docs.append(np.array(docs[start : i + 1], np.int64)[which])
            self.keys.append(keys)
            self.held += len(keys)
            start, n = i + 1, 0
            if self.held >= FLUSH:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        if self.held:
            yield from postings(np.concatenate(self.docs), np.concatenate(self.keys), self.parts)
        self.docs, self.keys, self.held = [], [], 0


def posted_sets(sets: DataFrame, read, num: int, den: int, strong: int, starts: range) -> DataFrame:
    """A stored table of rows ``(part, keys, docs)`` of ``postings``, for the (documents, sets) that ``read`` makes of batches."""
    parts = _parts(sets)

    def told(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poster = Poster(parts, Bands(num, den), strong, starts)
        for docs, own in read(batches):
            if rows := list(poster.add(docs, own)):
                yield told(rows)
        if rows := list(poster.flush()):
            yield told(rows)

    return stored(sets.mapInArrow(work, "part int, keys binary, docs binary"), "postings")


def _both(first: DataFrame, posted: DataFrame) -> DataFrame:
    """The components ``first`` joined by what the documents that stand for them share in ``posted``, which is deleted."""
    out = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(family_edges(posted)))
    dropped(posted)
    return out


def family_edges(posted: DataFrame) -> DataFrame:
    """``(a, b)``: edges that connect the documents of each family, from stored rows ``(part, keys, docs)`` of ``postings``.

    Neighbouring parts are taken together up to ``PART_BYTES``, as documents that share many signatures meet in many parts.
    """
    size = posted.agg(F.sum(F.octet_length("keys") + F.octet_length("docs"))).first()[0] or 0
    wide = min(_parts(posted), -(-size // PART_BYTES) or 1)
    together = F.when(F.col("part") >= 0, F.floor(F.col("part") * wide / _parts(posted))).otherwise(-1 - F.floor((-1 - F.col("part")) * wide / _parts(posted)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # documents that share many signatures meet in many parts: contract what a task has found
        for table in runs(batches, 1):
            part, keys, docs = (table.column(i).to_pylist() for i in range(3))
            held.append([np.frombuffer(b"".join(x), np.int64) for x in (keys, docs)] if part[0] < 0 else met_in_part(keys, docs))
            n += len(held[-1][0])
            if n >= EDGES_AT_ONCE:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    def told(held: list) -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = posted.select(together.cast("int").alias("part"), "keys", "docs").repartition(wide, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "a long, b long")


def _parts(df: DataFrame) -> int:
    """Into how many parts tasks deal signatures."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Index:
    """An inverted index over positions in the order they are added."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}

    def add(self, at: int, tokens: list[int]) -> None:
        for t in tokens:
            self.lists.setdefault(t, []).append(at)

    def search(self, tokens: list[int], least: int, weight: float = 0.01) -> Iterator[tuple[int, int, list[list[int]]]]:
        """(position, occurrences in short lists, long lists) of what may occur in ``least`` lists or more."""
        found = [x for t in tokens if (x := self.lists.get(t))]
        if len(found) < least:
            return
        found.sort(key=len)
        n_long = min(int(least / (weight * math.log2(len(found[-1]) + 1) + 1)), least - 1)
        short, long_ = found[: len(found) - n_long], found[len(found) - n_long :]
        at, n = -1, 0
        for x in heapq.merge(*short):
            if x == at:
                n += 1
                continue
            if n >= least - n_long and n:
                yield at, n, long_
            at, n = x, 1
        if n >= least - n_long and n:
            yield at, n, long_


def t_occurrence_links(ids: list[int], sets: list[np.ndarray], num: int, den: int, known: list[int] | None = None, big: int = 32) -> list[tuple[int, int]]:
    """Edges that join the documents linked at Jaccard >= num / den, directly or through others, to their smallest id.

    ``known``: components found earlier; documents of one are not searched for each other.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    size = [len(sets[i]) for i in order]
    root, members = list(range(len(order))), [[i] for i in range(len(order))]
    rest, bigs = _Index(), {}  # root of a large component: (tokens of one of its documents, its size, index)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x == y:
            return
        if len(members[x]) < len(members[y]):
            x, y = y, x
        root[y] = x
        members[x] += members[y]
        for z in [z for z in bigs if find(z) != z]:
            old = bigs.pop(z)
            bigs.setdefault(find(z), []).extend(old)

    def need(a: int, b: int) -> int:
        return -(-num * (a + b) // (num + den))

    if known:
        first: dict[int, int] = {}
        for q, i in enumerate(order):
            union(first.setdefault(known[i], q), q)
    for q, i in enumerate(order):
        tokens = sets[i].tolist()
        s = size[q]
        if not s:
            continue
        own = set(tokens)
        smallest = -(-num * s // den)
        least = need(s, smallest)
        search = [rest]
        for z, held in list(bigs.items()):
            for pivot, n, index in held:
                if find(z) == find(q):
                    continue
                if n >= smallest and len(own & pivot) >= need(s, n):
                    union(q, z)
                else:
                    search.append(index)
        for index in search:
            for at, n, long_ in index.search(tokens, least):
                if find(at) == find(q) or size[at] < smallest:
                    continue
                wanted = need(s, size[at])
                for k, x in enumerate(long_):
                    if n >= wanted or n + len(long_) - k < wanted:
                        break
                    j = bisect_left(x, at)
                    n += j < len(x) and x[j] == at
                if n >= wanted:
                    union(q, at)
        r = find(q)
        if r in bigs:
            bigs[r][0][2].add(q, tokens)
        else:
            rest.add(q, tokens)
            if len(members[r]) >= big:
                index = _Index()
                for m in sorted(m for m in members[r] if m <= q):
                    index.add(m, sets[order[m]].tolist())
                bigs[r] = [(own, s, index)]
    out = []
    for group in {find(x): members[find(x)] for x in range(len(order))}.values():
        names = sorted({ids[order[m]] for m in group})
        out += [(names[0], b) for b in names[1:]]
    return out


def class_rows(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, hi, lo, posted)``: for every row the size and the 128-bit key of its shingle set; and the rows
    ``(part, keys, docs)`` of ``postings`` of its first signatures. Of rows with equal sets a task posts one, marked ``posted``."""
    parts = _parts(docs)
    names = ["id", "n_shingles", "hi", "lo", "posted", "part", "keys", "docs"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]

    def sent(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        none = [pa.nulls(len(rows), k) for k in kinds[:5]]
        return pa.RecordBatch.from_arrays([*none, *(pa.array([r[i] for r in rows], kinds[5 + i]) for i in range(3))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, poster = Shingler(words), set(), Poster(parts, Bands(num, den), STRONG, FIRST)
        for batch in slices(batches, 1):
            ids, sets = batch.column(0).to_pylist(), [shingle(t) for t in batch.column(1).to_pylist()]
            keys = [set_key(x) for x in sets]
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen and len(sets[i]) and ids[i] is not None:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > 200_000:
                seen.clear()
            mark = np.zeros(len(ids), bool)
            mark[fresh] = True
            own = [batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(x) for x in sets], [k[0] for k in keys], [k[1] for k in keys])), pa.array(mark)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(ids), k) for k in kinds[5:])], names=names)
            if rows := list(poster.add([ids[i] for i in fresh], [sets[i] for i in fresh])):
                yield sent(rows)
        if rows := list(poster.flush()):
            yield sent(rows)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(work, "id long, n_shingles long, hi long, lo long, posted boolean, part int, keys binary, docs binary")


def linker(num: int, den: int):
    """For ``mapInArrow`` over rows ``(<group columns>, root, id, tokens)`` sorted by group: the links within each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            rows: dict[tuple, tuple] = {}
            for row in zip(*(table.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                rows.setdefault(row[1:], row)  # of a set that several tasks have sent, one
            roots, ids, sets = (list(x) for x in zip(*rows.values(), strict=True))
            known = [r if r is not None else i for r, i in zip(roots, ids, strict=True)]
            got = t_occurrence_links(ids, [np.frombuffer(x, np.uint64) for x in sets], num, den, known)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return work


def linked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: links among the rows ``(root, id, tokens)`` that agree in ``family, own, part``, one group at a time in a
    task; rows of one ``root``, if any, are linked already."""
    dealt = rows.select(*(F.col(c).cast("long") for c in ("family", "own", "part", "root")), "id", "tokens")
    return dealt.repartition("family", "own", "part").sortWithinPartitions("family", "own", "part").mapInArrow(linker(num, den), "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row; links are pairs with Jaccard >= num / den."""
    small_batches(docs.sparkSession)
    told = stored(class_rows(docs, words, num, den, id_col, text_col), "sets")
    rows = told.where("n_shingles is not null").select("id", "n_shingles", "hi", "lo", "posted")
    with_set = rows.where("n_shingles > 0 and id is not null")
    named = [F.min("id").alias("name"), F.min(F.when(F.col("posted"), F.col("id"))).alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")]
    classes = stored(with_set.groupBy("hi", "lo").agg(*named), "classes")
    first = components(family_edges(told.where("part is not null")))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        shingle = Shingler(words)
        for batch in slices(batches, 0):
            sets = [shingle(t) for t in batch.column(0).to_pylist()]
            keys = zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)
            kept = [i for i, key in enumerate(keys) if set_key(sets[i]) == key]  # rows may share an id
            yield batch.column(3).take(pa.array(kept, pa.int64())).to_pylist(), [sets[i] for i in kept]

    # the merge hints keep one plan at every size
    reps = classes.join(first.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("rep", "hi", "lo", F.coalesce("component", "rep").alias("root"))
    rest = texts.join(reps.hint("merge"), "rep").select("text", "hi", "lo", "root")
    families = _both(first, posted_sets(rest, read, num, den, STRONG, REST))
    members = classes.join(families.withColumnRenamed("id", "rep"), "rep").select("rep", "name", "hi", "lo", "n", F.col("component").alias("family"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(words), set()
        for batch in slices(batches, 0):
            kept, sets = [], []
            for i, (text, name, hi, lo) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                tokens = shingle(text)
                if (name, hi, lo) not in seen and set_key(tokens) == (hi, lo):  # rows may share an id
                    seen.add((name, hi, lo))
                    kept.append(i)
                    sets.append(tokens.tobytes())
            if len(seen) > 200_000:
                seen.clear()
            own = batch.select([1, 4, 5, 6]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sets, pa.binary())], names=["id", "family", "blocks", "own", "tokens"])

    met = texts.join(_blocks(members).hint("merge"), "rep").select("text", "name", "hi", "lo", "family", "blocks", "own")
    held = stored(met.mapInArrow(work, "id long, family long, blocks int, own int, tokens binary"), "family-sets")
    groups, found = _groups(held), []
    large = held.where("blocks > 1").select("id", "tokens")
    if not large.isEmpty():
        groups, found = _large_families(groups, large, num, den)
    pairs = _one_id(with_set, classes)
    found += [linked(groups, num, den)] + ([] if pairs is None else [pairs])
    joined = components(reduce(DataFrame.unionByName, found))
    final = classes.join(joined.withColumnRenamed("id", "name"), "name", "left").select("hi", "lo", "copies", F.coalesce("component", "name").alias("component_id"))
    known = joined_by_class(with_set.select("id", "n_shingles", "hi", "lo"), stored(final, "components"), ["hi", "lo"], "copies")
    alone = rows.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = known.select("id", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _groups(held: DataFrame, blocks: str = "blocks = 1") -> DataFrame:
    return held.where(blocks).select("family", "own", F.lit(0).alias("part"), F.lit(None).cast("long").alias("root"), "id", "tokens")


def _one_id(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``(a, b)``: edges between the classes of rows that share an id and not a text; none (the usual case) is null."""
    key = F.struct("hi", "lo")
    several = rows.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y").select("id", "x")
    if several.isEmpty():
        return None
    pairs = rows.join(several, "id").select("hi", "lo", "x").distinct()
    names = classes.select("hi", "lo", "name")
    first = names.select(F.struct("hi", "lo").alias("x"), F.col("name").alias("a"))
    return pairs.join(names, ["hi", "lo"]).join(first, "x").select("a", F.col("name").alias("b"))


def _blocks(members: DataFrame) -> DataFrame:
    """Adds ``(blocks, own)`` to the members (with ``name, n, family``) of families that have two or more: their block."""
    sizes = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    met = members.join(sizes.select("family", blocks.alias("blocks")), "family")
    return met.withColumn("own", F.pmod(F.xxhash64("name"), "blocks").cast("int"))


def _large_families(small: DataFrame, large: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """What is left to do (rows for ``linked``) with families that fit a block (``small``) and those that do not, and links
    found on the way. The sets ``(id, tokens)`` of the latter are dealt once more by stronger signatures.

    Of a family that is still too large, the largest component of each block goes first, through one document, so that a
    family of near copies becomes one component at little cost. Then each document outside its family's largest component
    meets all blocks of its family; those inside it are linked already and only meet the former.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for batch in slices(batches, 1):
            yield batch.column(0).to_pylist(), [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]

    posted = posted_sets(large, read, num, den, 2 * STRONG, FIRST)
    first = components(family_edges(posted))
    dropped(posted)
    rest = large.join(first.hint("merge"), "id", "left").select(F.coalesce("component", "id").alias("id"), "tokens")
    families = _both(first, posted_sets(rest, read, num, den, 2 * STRONG, REST))
    sized = large.select("id", (F.octet_length("tokens") / 8).cast("long").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    split = _blocks(sized.join(families, "id").select(F.col("id").alias("name"), "n", F.col("component").alias("family")))
    again = stored(large.join(split.withColumnRenamed("name", "id"), "id").select("id", "tokens", "family", "blocks", "own"), "family-sets")
    small, held = small.unionByName(_groups(again)), again.where("blocks > 1")
    if held.isEmpty():
        return small, []
    edges = lambda roots: roots.select(F.col("id").alias("a"), F.col("component").alias("b"))
    roots = components(linked(_groups(held, "true"), num, den))
    named = held.join(roots, "id", "left").select("id", "tokens", "family", "blocks", "own", F.coalesce("component", "id").alias("root"))
    named = stored(named, "blocks")
    largest = named.groupBy("family", "own", "root").agg(F.count("*").alias("n")).groupBy("family", "own").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("id"))
    pivots = named.select("id", "tokens", "family", (F.col("own") / BLOCK_DOCS).cast("int").alias("own")).join(largest.select("family", "id"), ["family", "id"])
    merged = components(linked(_groups(pivots, "true"), num, den))
    now = named.join(merged.select(F.col("id").alias("root"), "component"), "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    counts = now.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("tokens") / 8).alias("shingles"))
    main = counts.groupBy("family").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("all_n"), F.sum("shingles").alias("all_shingles"), F.max(F.struct("n", -F.col("root"), "shingles")).alias("most"))
    left = main.select("family", "main", (F.col("all_n") - F.col("most.n")).alias("docs"), (F.col("all_shingles") - F.col("most.shingles")).alias("shingles")).where("docs > 0")
    pieces = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES, F.lit(1))).cast("int")
    rest = stored(now.join(left.select("family", "main", pieces.alias("pieces")), "family"), "rest")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = rest.withColumn("part", F.explode(every("pieces")))
    visit = rest.where("root <> main").withColumn("part", F.pmod(F.xxhash64("id", "family"), "pieces").cast("int")).withColumn("own", F.explode(F.filter(every("blocks"), lambda b: b != F.col("own"))))
    cols = ["family", "own", "part", "root", "id", "tokens"]
    return small.unionByName(own.select(cols)).unionByName(visit.select(cols)), [edges(roots), edges(merged)]
