"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to), so the flow problem has one
node per pattern and one per source, however many documents there are. A pattern offers its tokens up to ``repeats`` times,
each repetition at a higher cost, and the sources' quotas draw on the patterns they share. The flow into a pattern then
becomes whole passes over all its documents plus a part of one more pass, which takes documents in the order of a seeded
hash of the row: two histograms of the hash find the bucket in which that part ends, and only that bucket's rows are ordered.

Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Rows without an
id, and repeated rows, count and are taken one by one: of rows equal in every column, so many as the part needs. The driver
holds one row for each membership pattern and source, and more than ``MOST_PATTERNS`` patterns are an error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Bits of the hash that each histogram tells apart, and of the whole hash.
BUCKET_BITS, HASH_BITS = 12, 63
MOST_PATTERNS = 50_000
#: Equal rows are written out in runs of so many.
RUN = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: int = 3) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``repeats`` times its size, and the excess is shared anew by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > repeats * sizes[i]]
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else left * weights[i] / whole
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def min_cost_flow(supplies: Mapping[object, int], members: Mapping[object, Sequence[int]], quotas: Sequence[int], repeats: int = 3) -> dict[object, int]:
    """Tokens that each pattern gives so that the quotas are met as far as they can be, with the least sum of repetition costs.

    ``supplies``: a pattern's size; ``members``: the sources it belongs to. The k-th pass over a pattern costs k a token.
    Successive shortest paths: each path starts at the source with quota left and ends at the cheapest pass it can reach,
    moving earlier flow between sources on the way.
    """
    used: dict[object, int] = dict.fromkeys(supplies, 0)
    sent: dict[tuple[object, int], int] = {}
    of_source: dict[int, list[object]] = {}
    for p, own in members.items():
        for s in own:
            of_source.setdefault(s, []).append(p)
    for start, quota in enumerate(quotas):
        left = int(quota)
        while left > 0:
            # Breadth first over sources: moving flow costs nothing, and ending at a pattern costs its next pass.
            seen: dict[int, tuple[object, int] | None] = {start: None}
            queue, best = deque([start]), None
            while queue:
                s = queue.popleft()
                for p in of_source.get(s, ()):
                    if supplies[p] > 0 and used[p] < repeats * supplies[p]:
                        cost = used[p] // supplies[p] + 1
                        if best is None or cost < best[0]:
                            best = (cost, p, s)
                    for other in members[p]:
                        if other not in seen and sent.get((p, other), 0) > 0:
                            seen[other] = (p, s)
                            queue.append(other)
            if best is None:
                break
            cost, p, s = best
            amount, path, at = min(left, cost * supplies[p] - used[p]), [], s
            while seen[at] is not None:
                via, before = seen[at]
                path.append((via, before, at))
                amount = min(amount, sent[(via, at)])
                at = before
            used[p] += amount
            sent[(p, s)] = sent.get((p, s), 0) + amount
            for via, before, at in path:
                sent[(via, at)] -= amount
                sent[(via, before)] = sent.get((via, before), 0) + amount
            left -= amount
    return used


def words_of(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def weigh_by_order(sources: Sequence[str | None]) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: float(i % 3 + 1) for i, s in enumerate(order)}


def fingerprint(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row, from 0 to below ``2 ** HASH_BITS``; columns with maps are hashed as JSON."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - HASH_BITS)


def plan(rows: DataFrame, weigh=weigh_by_order, repeats: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """The mix as two small tables, and whether the part of a pass ends among equal rows.

    ``rows``: ``sources`` (a sorted list of distinct sources), ``size`` and ``key`` (a hash in which equal rows agree). Returns
    one row per pattern ``(sources, passes, last_key, last_rows, last_of)``: its documents are taken ``passes`` times, those of
    smaller keys once more, and so are ``last_rows`` of the ``last_of`` rows of the last key; and one row per source ``(source,
    source_size, target)``.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("sources").agg(F.sum("size").alias("n"))
    in_order = lambda pattern: [(s is None, s or "") for s in pattern]
    patterns = sorted(((tuple(r[0]), int(r[1])) for r in sizes.limit(MOST_PATTERNS + 1).collect()), key=lambda x: in_order(x[0]))
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"there are more than {MOST_PATTERNS} sets of sources")
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: in_order([s]))
    weights, own = weigh(names), dict.fromkeys(names, 0)
    for p, n in patterns:
        for s in p:
            own[s] += n
    total = sum(n for _, n in patterns)
    wanted = dict(zip(names, targets([own[s] for s in names], [weights[s] for s in names], total, repeats), strict=True))
    place = {s: i for i, s in enumerate(names)}
    given = min_cost_flow(dict(patterns), {p: [place[s] for s in p] for p, _ in patterns}, [round(wanted[s]) for s in names], repeats)
    told = spark.createDataFrame([(list(p), given[p] // n if n else 0, given[p] % n if n else 0) for p, n in patterns], "sources array<string>, passes long, part long")
    per_source = spark.createDataFrame([(s, own[s], wanted[s]) for s in names], "source string, source_size long, target double")
    # where the part of a pass ends: by the first bits of the key, then by more of them, then by key
    ends = told.where("part > 0").select("sources", F.lit(0).cast("long").alias("low"), F.col("part").alias("left"))
    for bits in (BUCKET_BITS, 2 * BUCKET_BITS, HASH_BITS):
        within = rows.where("size > 0").join(F.broadcast(ends), "sources")
        if bits > BUCKET_BITS:
            before = BUCKET_BITS if bits < HASH_BITS else 2 * BUCKET_BITS
            within = within.where(F.shiftright("key", HASH_BITS - before) == F.col("low"))
        sums = within.groupBy("sources", "left", F.shiftright("key", HASH_BITS - bits).alias("at")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("sources").orderBy("at"))
        crossed = sums.withColumn("upto", upto).where("upto >= left and upto - n < left")
        ends = spark.createDataFrame(crossed.select("sources", F.col("at").alias("low"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n", "rows").collect(), "sources array<string>, low long, left long, n long, rows long")
        if bits < HASH_BITS:
            ends = ends.select("sources", "low", "left")
    # the row that the end crosses goes with the nearer side
    last = {tuple(r.sources): (r.low, (2 * r.left * r.rows + r.n) // (2 * r.n), r.rows) for r in ends.collect()}
    rule = [(list(p), given[p] // n if n else 0, *last.get(p, (None, None, None))) for p, n in patterns]
    return spark.createDataFrame(rule, "sources array<string>, passes long, last_key long, last_rows long, last_of long"), per_source, any(0 < some < of for _, some, of in last.values())


def _ruled(rows: DataFrame, rule: DataFrame, ties: bool, row: Column, times: str) -> DataFrame:
    """``(sources, row, copies)``: rows (with ``sources, size, key``) and how often each is taken, each written ``times`` times
    (an expression over ``copies``). Equal rows among which the part ends are brought together, counted and written out in runs
    that are dealt out. ``row`` makes a struct of a row."""
    met = rows.join(F.broadcast(rule), "sources")
    at_end = (F.col("size") > 0) & (F.col("key") == F.col("last_key"))
    split = F.coalesce(at_end & (F.col("last_rows") > 0) & (F.col("last_rows") < F.col("last_of")), F.lit(False))
    extra = F.coalesce((F.col("key") < F.col("last_key")) | (at_end & (F.col("last_rows") > 0)), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(0).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("_i")
    out = met.where(~split).select("sources", row.alias("row"), copies.alias("copies")).where(f"{times} > 0").select("*", each(F.expr(times))).drop("_i")
    if not ties:
        return out
    equal = met.where(split).groupBy("sources").agg(F.first(row).alias("row"), F.first("passes").alias("passes"), F.first("last_rows").alias("some"), F.first("last_of").alias("of"))
    shares = F.array(F.struct((F.col("passes") + 1).alias("copies"), F.col("some").alias("n")), F.struct(F.col("passes").alias("copies"), (F.col("of") - F.col("some")).alias("n")))
    counted = equal.select("sources", "row", F.explode(shares).alias("s")).select("sources", "row", "s.copies", "s.n").withColumn("n", F.col("n") * F.expr(times)).where("n > 0")
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("start")).repartition("start")
    return out.unionByName(runs.select("sources", "row", "copies", each(F.least(F.lit(RUN), F.col("n") - F.col("start")))).drop("_i"))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.array(F.col(source_col).cast("string")).alias("sources"), words_of(F.col(text_col)).alias("size"), fingerprint(docs, seed).alias("key")]


def mix(docs: DataFrame, repeats: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken, copies, source)`` for every row, when each document has one source."""
    rows = stored(docs.select(*_sized(docs, seed, id_col, text_col, source_col)), "sizes")
    rule, per_source, ties = plan(rows, repeats=repeats)
    small = per_source.select(F.array("source").alias("sources"), "source_size", "target")
    out = _ruled(rows, rule, ties, F.struct("id", "size"), "1").join(F.broadcast(small), "sources")
    return out.select(F.col("row.id").alias(id_col), "row.size", "source_size", "target", (F.col("row.size") * F.col("copies")).alias("taken"), "copies", F.col("sources")[0].alias("source"))


def mixed_documents(docs: DataFrame, repeats: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    sized = _sized(docs, seed, id_col, text_col, source_col)
    rule, _, ties = plan(stored(docs.select(*sized), "sizes"), repeats=repeats)
    return _ruled(docs.select(F.struct("*").alias("whole"), *sized), rule, ties, F.col("whole"), "copies").select("row.*")


def mix_overlapping(rows: DataFrame, weigh=weigh_by_order, repeats: int = 3, seed: int = 7) -> DataFrame:
    """``(id, size, sources, copies)`` for rows ``(id, sources, size)`` whose documents may belong to several sources: ``sources``
    is a list (its order and repeats play no part; a null list is one of no sources, and such a document is not taken)."""
    listed = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    keyed = stored(rows.select("id", listed.alias("sources"), F.col("size").cast("long").alias("size"), fingerprint(rows.select("id", "sources", "size"), seed).alias("key")), "sizes")
    rule, _, ties = plan(keyed, weigh, repeats)
    return _ruled(keyed, rule, ties, F.struct("id", "size"), "1").select("row.id", "row.size", "sources", "copies")
