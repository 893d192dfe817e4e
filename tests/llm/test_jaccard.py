import random
import re
import tracemalloc

import numpy as np
import pytest
from cellmesa.llm import common, jaccard
from cellmesa.llm.common import components, forest


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, num, den):
    """{id: component} by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 12, 40, 150]))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text = text[: rng.randrange(len(text) + 1)]
        rows.append((i * 3, " ".join(text) if rng.random() < 0.9 else "\n".join(text).upper()))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (None, rows[0][1]), rows[1], (1003, "a\x1cb")]


@pytest.mark.parametrize(("seed", "k", "num", "den", "block"), [(1, 4, 85, 100, 1024), (2, 5, 80, 100, 2), (3, 3, 70, 100, 5), (4, 1, 50, 100, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, k, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    if seed == 4:  # signatures that tell little apart
        monkeypatch.setattr(jaccard, "STRONG", 1)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int").repartition(3)
    got = jaccard.jaccard_components(df, k, num, den).collect()
    want = brute(rows, k, num, den)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t, k))) for i, t in rows if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("known", [False, True])
def test_search_equals_brute_force(known):
    rng = random.Random(7)
    base = [rng.sample(range(500), 40) for _ in range(4)]
    sets = [np.array(sorted({*rng.choice(base)[: rng.randrange(20, 41)], *rng.sample(range(500), rng.randrange(5))}), np.uint64) for _ in range(120)]
    ids = list(range(120))
    edges = jaccard.t_occurrence_links(ids, sets, 3, 4, [0 if i in (0, 5) else i + 1 for i in ids] if known else None, big=4)
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 4 * len(x & y) >= 3 * len(x | y) or known and (b, a) == (0, 5):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {i: find(i) for i in ids}
    got = {i: i for i in ids} | {b: a for a, b in edges}
    assert got == want


def test_bands_hold_every_pair_that_can_link():
    bands = jaccard.Bands(85, 100)
    for s in range(1, 400):
        for t in range(s, s * 100 // 85 + 1):
            assert set(bands.of(s)) & set(bands.of(t))


@pytest.mark.parametrize("strong", [1, 2, 4, 9])
def test_linked_sets_share_a_signature(strong):
    rng = random.Random(strong)
    sets = [np.empty(0, np.uint64)]
    for _ in range(60):
        base = {rng.getrandbits(64) for _ in range(rng.choice([1, 3, 7, 8, 14, 15, 30, 45, 90, 200]))}
        for _ in range(8):
            some = set(base)
            for _ in range(rng.randrange(1 + len(base) // 5)):
                some.discard(rng.choice(sorted(base)))
                if rng.random() < 0.6:
                    some.add(rng.getrandbits(64))
            sets.append(np.array(sorted(some), np.uint64))
    which, keys = jaccard.signatures(sets, jaccard.Bands(85, 100), strong)
    own = [set(keys[which == i].tolist()) for i in range(len(sets))]
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x and x != y and 100 * len(x & y) >= 85 * len(x | y):
                linked += 1
                assert own[a] & own[b]
    assert linked > 200


def test_what_is_posted_comes_back():
    rng = np.random.RandomState(0)
    for step in (3, 300, 40_000, 10**14):
        docs = np.cumsum(rng.randint(1, step, 400)) - 50 * step
        keys = rng.randint(0, 2**63, 300).astype(np.uint64) * np.uint64(2) | np.uint64(1)
        mine, own = rng.choice(docs, 900), rng.choice(keys, 900)
        rows = [r for half in (slice(0, 400), slice(400, 900)) for r in jaccard.postings(mine[half], own[half], 8)]
        pairs = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for p, a, b in rows if p < 0]
        for part in range(8):
            sent = [(a, b) for p, a, b in rows if p == part]
            if sent:
                pairs.append(jaccard.met_in_part(*map(list, zip(*sent, strict=True))))
        got = dict(zip(*(x.tolist() for x in forest(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))), strict=True))
        first = {}
        want = forest(mine, np.array([first.setdefault(k, d) for k, d in zip(own.tolist(), mine.tolist(), strict=True)]))
        assert got == dict(zip(*(x.tolist() for x in want), strict=True))


def test_forest_and_large_edge_tables(spark, monkeypatch):
    rng = np.random.RandomState(1)
    a, b = rng.randint(0, 3000, 2500), rng.randint(0, 3000, 2500)
    u, v = forest(a, b)
    want = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert all(want.get(x, x) == want.get(y, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)) and all(x not in want for x in v.tolist())
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 100)  # more than one task may hold
    got = components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(5))
    assert {r.id: r.component for r in got.collect() if r.id != r.component} == want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (5, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 6: 5}


def test_memory_of_a_part():
    """Arrays for the postings that meet at once, which each of an executor's tasks holds."""
    rng, keys, docs, sent = np.random.default_rng(0), [], [], 0
    while sent < jaccard.PART_BYTES:
        rows = jaccard.postings(np.sort(rng.integers(0, 1 << 40, 20_000)), rng.integers(0, 1 << 46, 20_000).astype(np.uint64) << np.uint64(16), 1)
        for _, k, d in (r for r in rows if r[0] >= 0):
            keys.append(k)
            docs.append(d)
            sent += len(k) + len(d)
    tracemalloc.start()
    jaccard.met_in_part(keys, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20, peak


def test_copies_do_not_meet_anew_in_every_part(spark, monkeypatch):
    """More documents have more parts, and near copies share signatures in most of them."""
    rng, rows = random.Random(3), []
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for j in range(8):
            text = list(base)
            text[rng.randrange(300)] = text[rng.randrange(300)] = f"x{i}-{j}"
            rows.append((8 * i + j, " ".join(text)))
    made, edges = [], jaccard.family_edges

    def counted(posted):
        out = common.stored(edges(posted), "counted")
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "family_edges", counted)
    monkeypatch.setattr(jaccard, "PART_BYTES", 24 << 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 5, 80, 100).collect()}
    assert got == {i: i - i % 8 for i, _ in rows}
    assert 0 < sum(made) < 5 * len(rows), made
