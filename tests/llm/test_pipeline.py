import hashlib
import random
from collections import Counter

import pytest
from cellmesa.llm import mixing, quality

from .test_jaccard import brute as components
from .test_quality_and_mixing import brute as measured

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def documents():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "Stone", "river", "it's", "end."] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([4, 15, 40, 200])))
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
    for i in range(60, 80):
        base = rows[rng.randrange(60)]
        text = base[1].split(" ")
        if i % 2:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), "en", base[3], 0))
    rows += [(90, None, None, "a", None), (91, "", "en", "a", 0), (92, "spam spam spam spam spam " * 20, "en", "b", 1), (93, "## " * 30 + "words and more words", "en", "b", 1)]
    return rows


def clean(text):
    n, chars, symbols, dup, repeat = measured(text)
    lines = [x for x in (text or "").split("\n") if x.split()]
    fails = n < 10 or 100 * repeat > 20 * n or len(lines) >= 4 and 100 * dup > 50 * len(lines) or 10 * symbols > n
    return not (fails or chars < 2 * n or chars > 15 * n or 4 * (text or "").count("!") > n)


def test_stages_equal_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(documents(), schema)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = [r for r in documents() if clean(r[1])]
    assert sorted(kept.collect()) == sorted(docs.where(docs.doc_id.isin([r[0] for r in want])).collect())
    one = corpus_pipeline.dedup_stage(spark, kept, "")
    comp = components([(r[0], r[1]) for r in want], 5, 80, 100)
    left = [r for r in want if comp[r[0]] == r[0]]
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r[0] for r in left} and len(left) < len(want)
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(left, schema)).collect()}
    mixed = corpus_pipeline.mix_stage(spark, one, "")
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in left}
    final = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter(r.doc_id for r in final) == Counter({i: n for i, n in taken.items() if n})
    for r in final:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_columns_with_any_names(spark):
    rows = [(1, "some words that make up a text of ten words", "a", 1, "k"), (1, "some words that make up a text of ten words", "a", 1, "k"), (None, "other words that make up a text of ten words", None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int, c0 string")
    got = quality.passing(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    one = corpus_pipeline.dedup_stage(spark, docs.withColumnRenamed("words", "component_id"), "")
    assert one.columns == ["doc_id", "text", "source", "component_id", "c0"] and one.count() == 3
    mixed = mixing.mixed_documents(docs.withColumnRenamed("words", "size").withColumnRenamed("c0", "sources"))
    assert mixed.columns == ["doc_id", "text", "source", "size", "sources"]
    assert quality.passing(docs.limit(0)).count() == 0 and corpus_pipeline.dedup_stage(spark, docs.limit(0), "").count() == 0
