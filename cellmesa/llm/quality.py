"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document: the ledger holds the measurements and one bit for each rule that the document
fails. Versioned policies are masks over those bits, so a policy, or an ablation of it, costs a bitwise test and no second
reading of the texts.

Null and empty texts have no words and fail the rule on length. Repeated rows, and rows without an id, each get their own
row; other columns of the input play no part unless ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 5
#: Rules by bit: a name and when a document fails, over the measurements. Bits are never given a new meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("many_exclamations", "4 * n_exclaims > n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "repeated_lines", "many_symbols", "short_words", "long_words", "many_exclamations"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << next(i for i, (name, _) in enumerate(RULES) if name == rule)


def mask(rules: Sequence[str]) -> int:
    return reduce(lambda a, b: a | b, map(bit, rules), 0)


def measure(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``n_words word_chars n_symbols n_exclaims n_lines n_dup_lines n_repeat_words``, all long.

    Windows of five words are told apart by 64-bit hashes of the words' hashes. Only texts in which some window comes again
    have their windows sorted to find where.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    k = [f"_k{i}" for i in range(len(kept))]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    bare = F.translate(text, " \t\n\x0b\f\r", "")
    first = docs.select(
        *kept,
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(bare) - F.length(F.translate(bare, "!", ""))).cast("long").alias("n_exclaims"),
        lines.alias("lines"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines"]
    hashed = first.select(
        *k,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_exclaims",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = hashed.select(
        *k,
        *counts,
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*(F.col("h")[i + j] for j in range(WINDOW)))),
        ).alias("w"),
    )
    again = F.size("w") > F.size(F.array_distinct("w"))
    ordered = windows.select(*k, *counts, F.when(again, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    s = F.col("s")
    same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
    starts = ordered.select(*k, *counts, F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("p"))
    covered = F.aggregate(
        F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return starts.select(*(F.col(a).alias(c) for a, c in zip(k, keep, strict=True)), *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failures``: a long with one bit for each rule that fails."""
    bits = [F.when(F.expr(when), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, when) in enumerate(RULES)]
    return measured.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Sequence[str], failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policies(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Adds a column ``kept_<version>`` for each policy."""
    return rows.select("*", *(passes(rules).alias(f"kept_{name}") for name, rules in policies.items()))


def ablations(rows: DataFrame, policy: Sequence[str] = POLICIES[CURRENT]) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it."""
    whole, f = mask(policy), F.col("failures")
    under = f.bitwiseAND(F.lit(whole).cast("long"))
    each = [
        F.struct(
            F.lit(r).alias("rule"),
            F.count_if(f.bitwiseAND(F.lit(bit(r)).cast("long")) != 0).alias("n_failed"),
            F.count_if(under == bit(r)).alias("n_failed_alone"),
            F.count_if(f.bitwiseAND(F.lit(whole & ~bit(r)).cast("long")) == 0).alias("n_kept_without"),
        )
        for r in policy
    ]
    return rows.agg(F.array(*each).alias("x"), F.bit_or("failures").alias("any_failed")).select(F.inline("x"))


def passing(docs: DataFrame, policy: Sequence[str] = POLICIES[CURRENT], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns.

    The row number stands between the test and the measurements: a filter is never moved below a projection that is not
    deterministic. Moved there, it would be written out in terms of the text, with every shared intermediate copied at each
    of its uses, and outgrow the optimizer.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = ledger(measure(docs.toDF(*names), names[docs.columns.index(text_col)], names)).withColumn("row", F.monotonically_increasing_id())
    kept = rows.where(passes(policy) & (F.col("row") >= 0))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def quality_rules(docs: DataFrame, policy: Sequence[str] = POLICIES[CURRENT], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements, failure bits, ``base_failed`` and ``kept`` under ``policy`` for every row."""
    rows = ledger(measure(docs, text_col, (id_col,)))
    return rows.select("*", (~passes(BASE)).alias("base_failed"), passes((*BASE, *policy)).alias("kept"))
