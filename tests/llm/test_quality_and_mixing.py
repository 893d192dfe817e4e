import random
import re
from collections import Counter

import pytest
from cellmesa.llm import mixing, quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one two three four five six seven eight nine ten eleven",
    "a b c d e a b c d e a b c d e",
    "x " * 4000,
    "line one is here\nline one is here\n\n  \nline one is here\nother line of the text",
    "## $$ %% && || <> ** words of a text with many symbols in it",
    "é中 nbsp x\x1cy\x85z 😀😀 a b c d e f",
    "p q r s t u p q r s t v p q r s t u " * 3,
]


def test_measurements_equal_brute_force(spark):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "z"), (None, TEXTS[4], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = quality.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = TEXTS[4] if r.doc_id is None else TEXTS[r.doc_id]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_policies_and_ablations_are_masks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = quality.ledger(quality.measure(df))
    kept = quality.apply_policies(rows).collect()
    assert all(not r.kept_v2 or r.kept_v1 for r in kept)
    bits = [r.failures for r in kept]
    for r in quality.ablations(rows).collect():
        b, whole = quality.bit(r.rule), quality.mask(quality.POLICIES[quality.CURRENT])
        assert r.n_failed == sum(x & b != 0 for x in bits)
        assert r.n_failed_alone == sum(x & whole == b for x in bits)
        assert r.n_kept_without == sum(x & whole & ~b == 0 for x in bits)


def test_targets_stop_at_three_times_a_source():
    assert mixing.targets([10, 10, 10], [1, 2, 3], 30) == [5, 10, 15]
    got = mixing.targets([100, 1, 5], [1, 2, 3], 106)
    assert got[1:] == [3, 15] and got[0] == 88
    assert mixing.targets([0, 0], [1, 2], 0) == [0, 0]


def test_flow_shares_overlaps_and_repeats_evenly():
    # source 0 can only be served by what it shares with source 1, which then has to use its own
    got = mixing.min_cost_flow({"own": 10, "both": 10}, {"own": [1], "both": [0, 1]}, [10, 10])
    assert got == {"own": 10, "both": 10}
    got = mixing.min_cost_flow({"own": 10, "both": 10}, {"own": [1], "both": [1, 0]}, [10, 30])
    assert sum(got.values()) == 40 and max(got.values()) <= 20
    assert mixing.min_cost_flow({"a": 5}, {"a": [0]}, [100]) == {"a": 15}


def rows_of(n=300):
    text = lambda k: " ".join(["w"] * k)
    rows = [(i, text(i % 7 + 1), ["s1", "s2", "ünit", None][i % 10 if i % 10 < 3 else 3 if i % 10 == 9 else 0]) for i in range(n)]
    return [*rows, (7, None, "s1"), (8, "", "s9"), (None, text(3), "s2"), (5, text(4), "s1"), (5, text(4), "s1")]


def test_mix_comes_near_its_targets(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows_of()], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows_of())
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.target, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    total = sum(r.size for r in got)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_target.setdefault((r.target, r.source_size), []).append(r)
    assert abs(sum(t for t, _ in by_target) - total) < 1e-6
    for (target, size), own in by_target.items():
        assert abs(sum(r.taken for r in own) - target) <= 8
        assert size == sum(r.size for r in own)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_equal_rows_are_taken_one_by_one(spark, monkeypatch, repeated):
    monkeypatch.setattr(mixing, "RUN", 100)  # equal rows are written out in runs
    rows = [(7 if repeated else None, "a b c d e", s) for s in ("x", "y", "z") for _ in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted((t, sum(r.taken for r in got if r.target == t)) for t in {r.target for r in got}) == [(2500.0, 2500), (5000.0, 5000), (7500.0, 7500)]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and Counter(r.source for r in mixed.collect()) == {"x": 500, "y": 1000, "z": 1500}


def test_overlapping_sources(spark):
    """Every quota that the documents can fill is filled, and as evenly as they allow."""
    rng = random.Random(2)
    rows = [(i, sorted(rng.sample("abc", rng.choice([1, 1, 2, 3]))) + ["a"] * (i % 50 == 0), rng.randrange(1, 20)) for i in range(2000)]
    rows += [(-1, None, 5), (-2, [], 5), (-3, ["c"], 0), (-4, ["b", None], 9)]
    got = mixing.mix_overlapping(spark.createDataFrame(rows, "id long, sources array<string>, size long")).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    assert {r.id: r.copies for r in got if r.id in (-1, -2, -3)} == {-1: 0, -2: 0, -3: 0}
    patterns, taken = {}, {}
    for r in got:
        key = tuple(r.sources)
        patterns[key] = patterns.get(key, 0) + r.size
        taken[key] = taken.get(key, 0) + r.size * r.copies
    names = ["a", "b", "c", None]
    sizes = [sum(n for p, n in patterns.items() if s in p) for s in names]
    quotas = [round(x) for x in mixing.targets(sizes, [1, 2, 3, 1], sum(patterns.values()))]
    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    flow = mixing.min_cost_flow({p: patterns[p] for p in order}, {p: [names.index(s) for s in p] for p in order}, quotas)
    assert all(abs(taken[p] - flow[p]) <= 10 for p in patterns)
    assert sum(flow.values()) == sum(quotas)


def test_flow_costs_no_more_than_any_other(spark):
    rng = random.Random(4)
    for _ in range(30):
        patterns = {p: rng.randrange(0, 5) for p in [(0,), (1,), (0, 1)]}
        quotas = [rng.randrange(0, 8), rng.randrange(0, 8)]
        flow = mixing.min_cost_flow(patterns, {p: list(p) for p in patterns}, quotas)
        cost = lambda used, n: sum(k // n + 1 for k in range(used)) if n else 0
        best = None
        for a in range(3 * patterns[(0,)] + 1):
            for b in range(3 * patterns[(1,)] + 1):
                for c in range(3 * patterns[(0, 1)] + 1):
                    if a <= quotas[0] and b <= quotas[1] and a + b + c <= sum(quotas):
                        found = (-(a + b + c), cost(a, patterns[(0,)]) + cost(b, patterns[(1,)]) + cost(c, patterns[(0, 1)]))
                        best = found if best is None else min(best, found)
        assert (-sum(flow.values()), sum(cost(flow[p], patterns[p]) for p in patterns)) == best


def test_mixed_documents_are_the_rows_as_often_as_taken(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, text string, source string")
    taken = sum(r.taken for r in mixing.mix(df).collect())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len(re.findall(WORD, r.text or "")) for r in mixed.collect()) == taken


@pytest.mark.parametrize("sources", [["b", None, "a"], ["a"], []])
def test_weights_follow_code_points(sources):
    want = {"a": 1.0, "b": 2.0, None: 3.0}
    assert mixing.weigh_by_order(sources) == {s: want[s] for s in sources}
