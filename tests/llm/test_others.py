import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from cellmesa.llm import chat, embeddings, licenses, urls, warc
from pyspark.sql import functions as F


# --- WARC


def test_archives_round_trip(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/ü x", "same"), (9, None, None), (3, "u", ""), (7, "u", "é" * 100_000), (None, "u", "same"), (2, "again", "same"), (11, "u", "a\r\n\r\nWARC/1.0\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = warc.round_trip(df, payloads=True).collect()
    assert len(got) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((t or "").encode()), digest(t), *(("revisit", 2) if t == "same" and i == 5 else ("revisit", 3) if i == 9 else ("response", None))) for i, _, t in rows]
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=lambda x: (x[0] is None, x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} >= {"same", "é" * 100_000, "a\r\n\r\nWARC/1.0\r\n"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_inflating_in_pieces_and_errors():
    raw = b"".join(warc.record(i, f"u{i}", bytes([i]) * (i * 1000), None) for i in range(40))
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = whole.compress(raw) + whole.flush()
    for data in (stream, b"".join(warc.member(r, 3) for _, r in warc.records(iter([raw])))):
        got = [r for _, r in warc.records(warc.inflated(io.BytesIO(data), 777))]
        assert b"".join(got) == raw and len(got) == 40
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-3]])))
    # a stream cut off anywhere, also where a record ends
    flushed = zlib.compressobj(6, zlib.DEFLATED, 31)
    at_end = flushed.compress(warc.record(1, "u", b"x", None)) + flushed.flush(zlib.Z_FULL_FLUSH)
    for cut in (stream[: len(stream) // 2], stream[:-1], at_end, warc.member(raw, 3) + stream[:50]):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(io.BytesIO(cut))))


def test_common_payloads_and_lost_records(spark, monkeypatch):
    rows = [(i, "u", "the error page" if i % 3 else f"page {i}") for i in range(1, 900)] + [(None, "u", "the error page")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    assert {(r.record_type, r.refers_to) for r in got if r.id and r.id % 3 and r.id > 1} == {("revisit", 1)}
    assert {r.record_type for r in got if not r.id or r.id % 3 == 0 or r.id == 1} == {"response"}
    short = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda *a, **b: short(*a, **b).selectExpr("path", "n + 1 as n"))
    with pytest.raises(ValueError, match="were written"):
        warc.round_trip(df)


# --- chat


def test_fold():
    e = [(1, "open", "user", None), (1, "delta", None, "he"), (1, "delta", None, "y"), (2, "open", "assistant", "x"), (2, "delta", None, "y"), (3, "open", "user", "z"), (2, "regenerate", None, None), (2, "delta", None, "new"), (3, "delta", None, "lost"), (9, "edit", None, "none"), (1, "edit", None, "hi"), (4, "open", None, "q"), (4, "delete", None, None), (2, "odd", None, "?")]
    assert chat.fold(e) == [("user", "hi"), ("assistant", "new")]


def test_logs_of_all_kinds_on_spark(spark):
    """Events in any order, ties, unknown kinds, and several conversations, folded on Spark as in one list."""
    rng = random.Random(8)
    rows = []
    for conv in [*range(40), None]:
        for seq in range(rng.randrange(1, 30)):
            kind = rng.choice(["open", "open", "delta", "delta", "edit", "regenerate", "delete", "odd"])
            rows.append((conv, rng.choice([seq, seq // 2]), rng.randrange(4), kind, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a<b", "\\n"])))
    log = list(rows)
    rng.shuffle(log)
    df = spark.createDataFrame([(*r, 0) for r in log], "conv_id long, seq long, message long, kind string, role string, text string, n_turns int").repartition(5)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    null_first = lambda r: (r[1], r[2], r[3], r[4] is not None, r[4] or "", r[5] is not None, r[5] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=null_first)
        messages = chat.fold([r[2:] for r in own])
        text, mask = chat.render(messages)
        assert (got[conv].formatted, list(zip(got[conv].loss_starts, got[conv].loss_ends, strict=True)), got[conv].n_turns) == (text, mask, len(messages))
    assert len(got) == 41


def test_any_text_comes_back():
    rng = random.Random(1)
    parts = ["</turn>\n", "<turn:user>\n", "\\", "\\\\", "<", ">", "\n", "n", "\\n", "é", ""]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "", "a>b\nc\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, mask = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "</turn>"), (3, 5, "user", "x" * 100_001)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.events_of(df))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == sha("bb") and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha("\n\n") and got[None].turns_sha256 == sha("user\n</turn>\n")
    assert got[3].formatted_chars == 100_001 + 17 + 4
    assert chat.format_conversations(chat.events_of(df.limit(0))).count() == 0


# --- embeddings


def brute_links(rows, cosine):
    units = [(i, l, embeddings.unit(v)) for i, v, l in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, u) in enumerate(units):
        for b, (j, y, v) in enumerate(units[:a]):
            if None not in (i, j, x, y) and x == y and u is not None and v is not None and len(u) == len(v) and float(u @ v) >= cosine:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(units):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, n[a], least.get(find(a))) for a, (i, _, _) in enumerate(units)), key=str)


@pytest.mark.parametrize(("dim", "block"), [(64, 2048), (48, 16), (5, 8)])
def test_vectors_link_as_in_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.RandomState(dim)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(160):
        v = base[rng.randint(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((int(i), [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.randint(2))))
    same = rows[0][1]
    rows += [(200 + i, same, rows[0][2]) for i in range(30)] + [rows[3], (400, None, 1), (401, [0.0] * dim, 1), (402, [float("nan")] + same[1:], 1), (403, same, None), (None, same, rows[0][2]), (404, [None] + same[1:], 1), (405, same[:3], 1), (406, [1e300] * dim, 1), (407, [2e300] * dim, 1), (408, [float("inf")] * dim, 1), (409, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cls string").repartition(3)
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize(("narrow", "smaller"), [(False, 3), (True, 1)])
def test_large_labels_are_dealt_to_cells(spark, monkeypatch, narrow, smaller):
    """Tables of cells, pairs that share several, and cells that stay large, against all pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "SMALLER", smaller)
    rng = np.random.RandomState(3)
    base = rng.normal(size=(150, 64)) + (5 if narrow else 0)
    rows = [(i, [float(np.float32(x)) for x in base[rng.randint(150)] + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.1])], 1) for i in range(500)]
    assert embeddings.dealing(500, 0.98)[0] > 0 or smaller == 1
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, 0.98)


def test_dealing_grows_slowly():
    assert embeddings.dealing(2048, 0.98) == (0, 1)
    assert embeddings.dealing(40_000, 0.5) == (0, 1)  # tables would be more work than all pairs
    for n in (20_000, 10**6, 10**9):
        signs, tables = embeddings.dealing(n, 0.98)
        assert n / 2**signs <= embeddings.BLOCK / 4 and tables < 80


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_calibrated_count_keeps_pairs_at_the_threshold():
    rng = np.random.RandomState(0)
    width, least = embeddings.calibrated(64, 0.98)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = rng.normal(size=a.shape)
    t -= (t * a).sum(1, keepdims=True) * a
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * t
    d = embeddings.directions(64)
    assert ((np.abs((a - b) @ d) <= width).sum(1) >= least).all()
    assert ((np.abs((a - a[::-1]) @ d) <= width).sum(1) >= least).mean() < 0.01


# --- urls


def test_rules_and_templates(spark):
    rows = [(1, "http://X.Example.ORG/es/a?q"), (2, "https://example.org/en/17#x"), (3, "http://a.com/de/1"), (4, "http://a.com/fr"), (5, None), (6, "no scheme"), (7, "http://notexample.org/es/a"), (8, "http://com/fr/x"), (8, "http://com/fr/x"), (9, "a://b://c/d"), (10, "http://h/?x://y/z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    told = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert told[1] == ("x.example.org", "/es/a", "example.org/es/", "block")
    assert told[2] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert told[3] == ("a.com", "/de/1", "com/de/", "block")
    assert told[4] == ("a.com", "/fr", None, "allow")
    assert told[5] == told[6] == ("", "", None, "allow")
    assert told[7] == ("notexample.org", "/es/a", "org/", "allow")
    assert told[8] == ("com", "/fr/x", "com/fr/", "allow")
    assert told[9] == ("b:", "//c/d", None, "allow") and told[10] == ("h", "/", None, "allow")
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_labels_reject_templates(spark):
    pages = [(i, f"http://s.net/{'spam' if i % 2 else 'news'}/{i}/x") for i in range(80)] + [(100 + i, f"http://s.net/{k}/page") for i, k in enumerate("abcdefghijklmnopq")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, bad int")
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, labels, rules=()).collect()}
    assert got[1].template == "/*/*/x" or got[1].template == "/spam/*/x"
    few = spark.createDataFrame(pages[:80], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(few, labels, rules=()).collect()}
    assert got[1].template == "/spam/*/x" and got[79].verdict == "block" and got[78].verdict == "allow"


def test_only_siblings_with_like_labels_are_merged(spark):
    """Branches of a few bad urls each are rejected together; unlabelled and clean ones are left alone."""
    pages, bad = [], {}

    def add(path, label=None):
        pages.append((len(pages), f"http://s.net{path}"))
        if label is not None:
            bad[len(pages) - 1] = label

    for name in ("pills", "casino", "bets"):
        for k in range(3):
            add(f"/{name}/{name}-{k}", 1)
    for name in ("news", "sport"):
        for k in range(30):
            add(f"/{name}/{name}-{k}", 0)
    for k in range(30):
        add(f"/new/new-{k}")
    labels = spark.createDataFrame(list(bad.items()), "id long, bad int")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels, rules=()).collect()}
    told = {u.split("/")[3]: got[i] for i, u in pages}
    assert {k: r.verdict for k, r in told.items()} == {"pills": "block", "casino": "block", "bets": "block", "news": "allow", "sport": "allow", "new": "allow"}
    assert told["pills"].template == told["bets"].template != told["news"].template == told["sport"].template
    assert told["pills"].support == 9 and told["new"].support == 0 and told["new"].template == "/new/*"


def test_rules_say_nothing_about_siblings(spark):
    rows = [(i, f"http://a.com/{'de' if i % 2 else 'es'}/x/p{i}") for i in range(80)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {(r.path[:4], r.verdict) for r in got} == {("/de/", "block"), ("/es/", "allow")}
    assert all(r.purity < 0.1 for r in got)
    # and with the labels of the blocked ones, the others still have none of their own
    labels = spark.createDataFrame([(i, 1) for i in range(1, 80, 2)], "id long, bad int")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()
    assert {(r.path[:4], r.verdict, r.support) for r in got} == {("/de/", "block", 40), ("/es/", "allow", 0)}


def test_templates_equal_brute_force(spark):
    """Wildcards, branches, purities and verdicts of random hosts, against the same rules applied to lists."""
    rng = random.Random(5)
    words = ["en", "de", "shop", "tag", "a-b"]
    pages = []
    for i in range(900):
        host = rng.choice(["x.net", "x.net", "y.net", "z.net"])
        depth = rng.choice([0, 1, 2, 2, 3, 10])
        path = "".join("/" + rng.choice([rng.choice(words), str(rng.randrange(400)), f"{rng.choice(words)}{rng.randrange(3)}.html"]) for _ in range(depth))
        pages.append((i, f"http://{host}{path}{rng.choice(['', '/', '?q'])}", rng.choice([None, 0, 0, 1]) if "shop" not in path else rng.choice([1, 1, 1, None, 0])))
    df = spark.createDataFrame(pages, "page_id long, url string, bad int").repartition(3)
    got = {r.page_id: r for r in urls.judge(df, rules=(), bad_col="bad").collect()}
    want = tree(pages)
    assert {i: (r.template, r.verdict, r.support) for i, r in got.items()} == {i: x[:3] for i, x in want.items()}
    assert all(abs(r.purity - want[i][3]) < 1e-6 for i, r in got.items())
    assert len({x[1] for x in want.values()}) == 2


def tree(pages, threshold=0.5, strength=8.0, least=5, fanout=12, z=1.96):
    paths = {}
    for _, url, bad in pages:
        key = tuple(re.match(r"http://([^/?]*)([^?]*)", url).groups())
        n = paths.setdefault(key, [0, 0])
        n[0] += bad or 0
        n[1] += bad is not None
    shape = lambda rest: re.sub(r"[^\W\d]+", "a", re.sub(r"\d+", "9", "/".join(rest)))
    seg = {}
    for k in paths:
        parts = re.sub("/$", "", re.sub("^/", "", k[1])).split("/")
        seg[k] = parts if len(parts) <= urls.LEVELS else [*parts[: urls.LEVELS - 1], "/".join(parts[urls.LEVELS - 1 :])]
    template = {k: () for k in paths}
    for level in range(urls.LEVELS):
        nodes = {}
        for k, own in paths.items():
            if len(seg[k]) > level:
                node = nodes.setdefault((k[0], template[k]), {}).setdefault(seg[k][level], {"n": 0, "bad": 0, "labelled": 0, "shapes": {}})
                node["n"] += 1
                node["bad"] += own[0]
                node["labelled"] += own[1]
                s = shape(seg[k][level + 1 :])
                node["shapes"][s] = node["shapes"].get(s, 0) + 1
        names = {}
        for parent, children in nodes.items():
            total = sum(c["n"] for c in children.values())
            singles = sum(c["n"] == 1 for c in children.values())
            kin = {}
            for name, c in children.items():
                c["kin"] = (max((n, s) for s, n in c["shapes"].items())[1], 2 * c["bad"] > c["labelled"])
                if singles > 1 and c["n"] == 1 or len(children) > fanout and c["n"] * fanout < total:
                    names[(*parent, name)] = "*"
                else:
                    names[(*parent, name)] = name
                    if c["labelled"]:
                        kin.setdefault(c["kin"], []).append(name)
            for (s, mostly), group in kin.items():
                bad, labelled = (sum(children[x][c] for x in group) for c in ("bad", "labelled"))
                for x in group:
                    c = children[x]
                    if len(group) > 1:
                        share = (bad + 0.5) / (labelled + 1)
                        error = (share * (1 - share) * (1 / c["labelled"] + 1 / (labelled - c["labelled"]))) ** 0.5
                        if abs(c["bad"] / c["labelled"] - (bad - c["bad"]) / (labelled - c["labelled"])) <= z * error:
                            names[(*parent, x)] = "{" + "bad " * mostly + f"like {s}" + "}"
        for k in paths:
            if len(seg[k]) > level:
                template[k] += (names[(k[0], template[k], seg[k][level])],)
    counts = {}
    for k, own in paths.items():
        for n in range(len(template[k]) + 1):
            c = counts.setdefault((k[0], template[k][:n]), [0, 0])
            c[0] += own[0]
            c[1] += own[1]
    base = (sum(x for x, _ in paths.values()) + 0.1) / (sum(x for _, x in paths.values()) + 2)
    out = {}
    for i, url, _ in pages:
        k = tuple(re.match(r"http://([^/?]*)([^?]*)", url).groups())
        purity, ruling, support = base, None, 0
        for n in range(len(template[k]) + 1):
            bad, labelled = counts[(k[0], template[k][:n])]
            purity = (bad + strength * purity) / (labelled + strength)
            if n and labelled >= least:
                ruling, support = purity, labelled
            elif ruling is None:
                support = labelled
        blocked = ruling is not None and ruling >= threshold
        out[i] = ("/" + "/".join(template[k]), "block" if blocked else "allow", support, ruling if ruling is not None else purity)
    return out


def test_odd_paths(spark):
    """Long paths, deep paths, pages without labels or texts, rules of equal length, clashing columns."""
    rows = [(1, "http://h.net/" + "a/" * 5000, None, 1), (2, "http://h.net/" + "b" * 200_000, "", 1), (3, "http://h.net", "<p>" + "word " * 30 + "</p>", 1), (3, "http://h.net", "<p>" + "word " * 30 + "</p>", 1), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template int")
    pages = urls.labelled_pages(df)
    assert sorted((r.page_id or 0, r.bad) for r in pages.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    got = urls.judge(pages, bad_col="bad").collect()
    assert len(got) == 5 and {r.verdict for r in got} == {"allow"}
    assert urls.labelled_pages(df.limit(0)).count() == 0
    same = (("allow", "a.net", "/x"), ("block", "net", "/xyz"))  # as long, so the first given counts
    page = spark.createDataFrame([(1, "http://a.net/xyz")], "page_id long, url string")
    assert [urls.judge(page, rules=r).first().verdict for r in (same, same[::-1])] == ["allow", "block"]


# --- licences


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark)


def test_licences(spark, model):
    texts = {
        1: ("Some words.\nLicensed under the Apache License, Version 2.0.\nMore words.", "apache-2.0"),
        2: ("Released under the MIT License.", "mit"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        4: ("Licensed under CC BY-NC 4.0. And then the of words that go on", "cc-by-nc-4.0"),
        5: ("He renewed his driver's license at the office.", None),
        6: (None, None),
        7: ("", None),
        8: ("word " * 60_000 + "\nreleased under the mit license.", "mit"),
        9: ("The warranty of the product covers two years.", None),
        10: ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    }
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in texts.items()] + [(2, texts[2][0], 1), (None, texts[2][0], 1)], "doc_id long, text string, found int")
    rows = licenses.scan(df, model).collect()
    assert len(rows) == 12
    assert {r.doc_id: r.license for r in rows if r.doc_id} == {i: want for i, (_, want) in texts.items()}
    assert licenses.scan(df.limit(0), model).count() == 0


def test_accuracy_on_phrases_that_the_fit_has_not_seen(spark):
    seen, told = licenses.held_out(spark)
    families = [x for x in told if x[0] != licenses.UNKNOWN]
    assert sum(f == likely and p > 0.5 for f, likely, p in families) >= 0.9 * len(families) and len(families) > 300
    assert not [x for x in told if x[0] == licenses.UNKNOWN and x[1] != licenses.UNKNOWN and x[2] > 0.5]
    rows = licenses.examples(spark).collect()
    assert not {r.text.lower() for r in rows if r.fold == 0} & {r.text.lower() for r in rows if r.fold}


def test_scores_equal_a_softmax_over_lists(spark, model):
    """The scorer's columns against the same sums in plain Python."""
    texts = ["Licensed under the MIT License.", "Not licensed under the GPL-3.0 license, version 2.", "words without any", "", "the license of the Apache License, Version 2.0 is not the MIT license", "GNU  gpl\tversion 2 or CC0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", licenses.best(model, licenses.words_of(F.col("t"))).alias("b"), licenses.containment(licenses.words_of(F.col("t")), F.lit("mit")).alias("c")).orderBy("i").collect()
    for text, r in zip(texts, got, strict=True):
        words = [w for w in re.split(r"[^\w.]+|\.+(?=\D|$)", text.lower()) if w]
        grams = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1) if any(re.search(licenses.FEATURE_WORD, w) for w in words[k : k + n])}
        grams |= {"!"} if re.search(licenses.DENIED, " ".join(words)) else set()
        logits = np.array(model.intercepts) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.families)))
        p = np.exp(logits) / np.exp(logits).sum()
        assert r.b.family == model.families[int(p.argmax())] and abs(r.b.p - p.max()) < 1e-9
        assert abs(r.c - max(len(set(words) & licenses._template_words(t)) / len(licenses._template_words(t)) for t in licenses.TEMPLATES["mit"])) < 1e-12


def test_short_forms_and_denials(spark, model):
    texts = [
        ("Distributed under GPL-3.0.", "gpl-3.0"),
        ("SPDX: AGPL-3.0-only", "agpl-3.0"),
        ("License: MIT", "mit"),
        ("Released under the ISC License.", "isc"),
        ("GNU General Public License, version 2", "gpl-2.0"),
        ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("Not licensed under the MIT License.", None),
        ("The code is not released under the Apache License, Version 2.0.", None),
        ("She renewed her licence at MIT in 2020.", None),
        ("We are committed to open source; the license plate was stolen.", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(df, model).collect()} == {i: f for i, (_, f) in enumerate(texts)}


def test_wrapped_licences(spark, model):
    mit = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
    comment = lambda t, mark: "\r\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    texts = [
        (mit, ["mit"], 3),  # its heading, the grant and the condition
        (bsd, ["bsd-3-clause"], 2),
        (gpl, ["gpl-3.0"], 1),
        (comment(mit, " *"), ["mit"], 3),
        (comment(bsd, "#"), ["bsd-3-clause"], 2),
        (comment(gpl, "//"), ["gpl-3.0"], 1),
        (licenses.TEMPLATES["gpl-3.0"][1].replace(" ", "\n"), ["gpl-3.0"], 1),
        ("This work is licensed under a Creative Commons Attribution-\nNonCommercial 4.0 International License.", ["cc-by-nc-4.0"], 1),
        ("Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.\nHe renewed his driver's license.", ["apache-2.0", "mit"], 2),
        ("\n".join(licenses.COUNTEREXAMPLES), [], 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_paragraphs) for r in licenses.scan(df, model).collect()}
    assert got == {i: (names, n) for i, (_, names, n) in enumerate(texts)}


def test_cues_in_any_spelling(spark, model):
    spellings = (lambda t: t, lambda t: t.replace(" ", "-"), lambda t: t.replace(" ", "\t"), lambda t: t.replace("CC BY", "CC-BY"), lambda t: t.replace(" ", "\u00a0"), lambda t: t.replace(" ", "\n"), str.upper)
    rows = [(100 * i + k, f(t)) for i, t in enumerate(t for texts in licenses.TEMPLATES.values() for t in texts) for k, f in enumerate(spellings)]
    more = {-1: ("Content is available under CC-BY-SA 4.0 unless otherwise noted.", ["cc-by-sa-4.0"]), -2: ("Released under CC-BY-NC 4.0 for noncommercial use.", ["cc-by-nc-4.0"]), -3: ("Accounts of a summit in the commonwealth of submitted domains.", [])}
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in more.items()], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df, model).collect()}
    assert {i: got[i] for i in more} == {i: names for i, (_, names) in more.items()}
    # words are the same in every spelling, and so is what is found
    assert all(got[i] == got[i - i % 100] for i, _ in rows)
    # each word that a feature holds passes the text's pattern wherever it stands
    stems = [w.strip("^$") for w in licenses.CUE_WORD.split("|")]
    ends = spark.createDataFrame([(f"a{x}{w}{y}",) for w in stems for x in "-\t _\n/(" for y in ("", "-b", "\t", ".", "\n")], "t string")
    assert ends.where(~licenses.has_cue(F.col("t"))).count() == 0


def test_names_and_parts_of_sentences_without_a_cue(spark, model):
    """Every name is found in every phrase, also one of which no word is a cue, and so is what is left of a sentence without its cues."""
    said = [(frame.format(n), f) for f, names in licenses.NAMES.items() for n in names if n in licenses.TEMPLATES[f] for frame in licenses.FRAMES]
    said += [(frame.format(n), None) for n in ("EPL-2.0", "MPL-2.0") for frame in licenses.DENIALS]
    said += [
        ("License: ISC", "isc"),
        ("He follows the EPL and sees 2.0 goals a match.", None),
        ("is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "mit"),
        ("and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met.", "bsd-3-clause"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.license for r in licenses.scan(df, model).collect()}
    assert not [(t, f, got[i]) for i, (t, f) in enumerate(said) if got[i] != f]
    # no paragraph that a template confirms is without a feature
    for t in (t for texts in licenses.TEMPLATES.values() for t in texts):
        words = licenses._template_words(t)
        assert sum(not re.search(licenses.FEATURE_WORD, w) for w in words) < 0.75 * len(words)
    assert np.argmax(model.intercepts) == model.families.index(licenses.UNKNOWN)
