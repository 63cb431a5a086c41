"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that may count them). A flow network routes the
capacity of the patterns to the quotas of the sources; taking a pattern's words a second or third time costs more
each time (convex repetition costs), so repeats are spread evenly before anything is taken thrice. A pattern of one
source that no overlapping pattern touches is a component of the network with one arc, which carries the source's
quota: those, of any number, are solved in place, as are the quotas. Only components with overlapping patterns go to
the driver, whose size is checked.

Documents are then selected in a seeded order by a radix search over hash bins: counters by pattern and bin, a window
over a pattern's at most 1,024 bins, and a bounded set of documents around each cut. No sort, no shuffle of documents,
no window over a source.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import HEAVY_KEYS, WORD, materialise, numbered, partitions, release, renamed, spread_join

#: The most often that a document may be taken.
MAX_REPEATS = 3
#: The most patterns in components with overlapping sources, which are solved on the driver.
MAX_PATTERNS = 20_000
#: Documents of a pattern on each side of the cut that are filled one by one, and the most picked ones that are broadcast.
BOUNDARY_DOCS = 1_000
BROADCAST_PICKS = 100_000
_BIN_BITS = 10
_RANK_BITS = 60


def targets(sizes: dict, weights: tuple = (1, 2, 3), repeats: int = MAX_REPEATS) -> dict:
    """Each source's share of all words: by weight (repeating, sources by code point, null last), never above ``repeats`` times its size.

    What a capped source cannot hold is dealt to the others by weight, again and again until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)  # str sorts by code point
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / whole > repeats * sizes[s]]
        if not above:
            out |= {s: rest * weight[s] / whole for s in open_}
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
        rest -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def flow(patterns: dict, quotas: dict, repeats: int = MAX_REPEATS) -> dict:
    """Min-cost flow: {(pattern, source): words}. patterns: {tuple of sources: words}; the k-th repetition costs k a word.

    Successive shortest paths. Costs per lap are whole numbers, so all paths of one cost are used up before a dearer
    one. The reverse arcs let a pattern that two sources share be handed from one to the other.
    """
    sent: dict = {}
    used = dict.fromkeys(patterns, 0.0)
    need = dict(quotas)
    by_source: dict = {}
    for p in patterns:
        for s in p:
            by_source.setdefault(s, []).append(p)
    for lap in range(1, repeats + 1):
        room = {p: lap * patterns[p] - used[p] for p in patterns}
        for s in by_source:
            while need.get(s, 0) > 1e-9:
                # Breadth first from the source through patterns with room, or patterns that another source could give up.
                back, queue, end = {s: None}, deque([s]), None
                while queue and end is None:
                    at = queue.popleft()
                    for p in by_source.get(at, ()):
                        if ("p", p) in back:
                            continue
                        back["p", p] = at
                        if room[p] > 1e-9:
                            end = p
                            break
                        for other in p:
                            if other not in back and sent.get((p, other), 0) > 1e-9:
                                back[other] = p
                                queue.append(other)
                if end is None:
                    break
                path, p = [], end
                while True:
                    at = back["p", p]
                    path.append((p, at))
                    if back[at] is None:
                        break
                    p = back[at]
                    path.append((p, at, "gives"))
                amount = min([need[s], room[end]] + [sent[x[0], x[1]] for x in path if len(x) == 3])
                for x in path:
                    sent[x[0], x[1]] = sent.get((x[0], x[1]), 0.0) + (-amount if len(x) == 3 else amount)
                used[end] += amount
                room[end] -= amount
                need[s] -= amount
    return {k: v for k, v in sent.items() if v > 1e-9}


def fill(units: list[tuple[int, int]], gap: float) -> set[int]:
    """Keys of (key, size) units, in order, whose sizes come nearest to ``gap``: first fit, then the best single exchange or addition."""
    chosen, left = set(), gap
    for key, size in units:
        if 0 < size <= left:
            chosen.add(key)
            left -= size
    outside = sorted((size, key) for key, size in units if size > 0 and key not in chosen)
    best, swap = abs(left), None
    for gone, out_key in [(0, None)] + sorted({size: (size, key) for key, size in units if key in chosen}.values()):
        i = bisect_left(outside, (left + gone, -(1 << 63)))
        for size, key in outside[max(0, i - 1) : i + 1]:
            if (off := abs(left + gone - size)) < best:
                best, swap = off, (out_key, key)
    if swap:
        chosen.discard(swap[0])
        chosen.add(swap[1])
    return chosen


def _key(members: Column) -> Column:
    """A pattern as a string: one for each array of sources, nulls among them."""
    return F.array_join(F.transform(members, lambda x: F.when(x.isNull(), "n").otherwise(F.concat(F.lit("s"), F.length(x).cast("string"), F.lit(":"), x))), "")


def _joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join with a table of one row a key; ``n``: rows of ``left`` with it, ``rows`` in all. Few keys are broadcast."""
    if right.count() <= HEAVY_KEYS:
        return left.join(F.broadcast(right.drop("n")), key)
    return spread_join(left, right, key, "n", rows).drop("n")


def source_targets(sources: DataFrame, weights: tuple = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) in, (source, size, target) out: ``targets`` for any number of sources; only sums leave the executors."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ordered = sources.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered, "mix-sources")
    # A source's place: the sources of the partitions before its own, and its place there.
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, starts = 0, []
    for p, n in counts:
        starts.append((p, first))
        first += n
    place = F.broadcast(spark.createDataFrame(starts, "p long, first long"))  # one row a partition
    nth = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int"))
    weighed = ordered.withColumn("p", F.shiftright("at", 33)).join(place, "p").select("source", "size", weight.alias("weight"))
    most = repeats * F.col("size")
    sums = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, whole = float(sums["size"] or 0), float(sums["weight"] or 0)
    while whole:
        above = F.lit(rest) * F.col("weight") / F.lit(whole) > most
        r = weighed.agg(F.sum(F.when(above, most).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (float(sums["size"]) - r["held"], r["open"])
        if new == (rest, whole) or not r["open"]:
            rest, whole = new if r["open"] else (rest, whole)
            break
        rest, whole = new
    target = F.least(F.lit(rest) * F.col("weight") / F.lit(whole or 1.0), most.cast("double"))
    return weighed.select("source", "size", target.alias("target"))


def _overlapping(patterns: DataFrame, sources: DataFrame, repeats: int) -> DataFrame | None:
    """(key, taken) of the patterns in components with overlapping sources, by flow on the driver; None if there are none."""
    spark = patterns.sparkSession
    wide = patterns.filter(F.size("pattern") != 1)
    if wide.isEmpty():
        return None
    touched = wide.select(F.explode("pattern").alias("source")).distinct().withColumn("skey", _key(F.array("source")))
    single = patterns.filter(F.size("pattern") == 1).join(touched.select(F.col("skey").alias("key")), "key", "left_semi")
    got = wide.unionByName(single).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns in components with overlapping sources")
    names = {tuple(r["pattern"]): r["key"] for r in got}
    # As many quotas as the patterns have sources; a null source is told apart by its key.
    own = sources.withColumn("skey", _key(F.array("source"))).join(touched.select("skey"), "skey", "left_semi")
    quotas = {r["source"]: r["target"] for r in own.select("source", "target").collect()}
    taken = dict.fromkeys(names, 0.0)
    for (p, _), words in flow({tuple(r["pattern"]): r["words"] for r in got}, quotas, repeats).items():
        taken[p] += words
    return spark.createDataFrame([(names[p], float(t)) for p, t in taken.items()], "key string, taken double")


def _ranked(docs: DataFrame, members: Column | None, id_col: str, text_col: str, source_col: str, weights: tuple, repeats: int, seed: int, slim: bool) -> DataFrame:
    """``docs`` (slim: their ids alone) with __size, __source_size, __target and __times. Texts are read once for all counting passes."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    wide = docs.withColumns({"__size": size, "__source": source, "__skey": _key(F.array(source))})
    wide = wide.withColumn("__rank", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__source"), F.col("__size")), 64 - _RANK_BITS))
    pattern = F.array("__source") if members is None else F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    wide = wide.withColumn("__pattern", pattern).withColumn("__key", _key(F.col("__pattern")))
    counted = ["__pattern", "__key", "__skey", "__size", "__source", "__rank"]
    numbers = materialise(wide.select(F.col(id_col), *counted) if slim else wide.select(*counted), "mix-sizes")
    wide = numbers if slim else wide
    pairs = numbers.groupBy("__key", "__skey").agg(
        F.sum("__size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("__pattern").alias("pattern"), F.first("__source").alias("source")
    )
    pairs = materialise(pairs, "mix-pairs")
    patterns = materialise(pairs.groupBy(F.col("__key").alias("key")).agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.first("pattern").alias("pattern")), "mix-patterns")
    rows = patterns.agg(F.sum("n")).first()[0] or 0
    sizes = patterns.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size"))
    sources = materialise(source_targets(sizes, weights, repeats), "mix-targets")
    # Where nothing overlaps, a pattern's source takes its target, which never exceeds what the pattern can give.
    alone = sources.select(_key(F.array("source")).alias("key"), F.col("target").alias("taken"))
    planned = patterns.join(alone, "key", "left")
    flowed = None if members is None else _overlapping(patterns, sources, repeats)
    if flowed is not None:
        planned = planned.join(F.broadcast(flowed.withColumnRenamed("taken", "flowed")), "key", "left")
        planned = planned.withColumn("taken", F.coalesce("flowed", F.when(F.size("pattern") == 1, F.col("taken"))))
    taken = F.coalesce("taken", F.lit(0.0))
    full = F.when(F.col("words") > 0, F.least(F.lit(repeats), F.floor((taken + 1e-6) / F.col("words")))).otherwise(0).cast("int")
    plan = planned.select("key", "n", "words", taken.alias("taken"), full.alias("full"))
    gap = F.when((F.col("full") < repeats) & (F.col("words") > 0), F.greatest(F.lit(0.0), F.col("taken") - F.col("full") * F.col("words"))).otherwise(0.0)
    plan = materialise(plan.withColumn("gap", gap), "mix-plan")
    low, picked = _cut(numbers, plan, rows)
    plan = plan.join(low, "key", "left").select(F.col("key").alias("__key"), "n", F.col("full").alias("__full"), F.col("low").alias("__low"))
    plan = materialise(plan, "mix-cuts")
    own = pairs.groupBy("__skey").agg(F.sum("n").alias("n"))
    named = sources.select(_key(F.array("source")).alias("__skey"), F.col("size").alias("__source_size"), F.col("target").alias("__target"))
    own = materialise(own.join(named, "__skey", "left"), "mix-own-sources")
    out = _joined(_joined(wide, own, "__skey", rows), plan, "__key", rows)
    picked = picked.select(F.col("key").alias("__key"), F.col("rank").alias("__rank"), F.lit(1).alias("__more"))
    out = out.join(F.broadcast(picked) if picked.count() <= BROADCAST_PICKS else picked, ["__key", "__rank"], "left")
    more = (F.coalesce(F.col("__rank") < F.col("__low"), F.lit(False)) | F.col("__more").isNotNull()).cast("int")
    times = F.when(F.col("__size") > 0, F.least(F.lit(repeats), F.col("__full") + more)).otherwise(0)
    return out.withColumn("__times", times.cast("int"))


def mix(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, times, taken.

    size: words of the text (null: 0). taken = times * size: documents are taken whole, 0 to ``repeats`` times; empty
    ones never. ``members``: an array of the sources that may count a document; by default its own source alone.
    source_size and target are those of the document's own source. Rows with equal id, source and size are one unit:
    taken together or not. Null ids and null sources take part (null is a source of its own, the last). An empty table
    gives an empty result. Other columns are ignored. Reruns agree: the order is a hash with a fixed seed.
    """
    own = docs.select(*{id_col: F.col(id_col), text_col: F.col(text_col), source_col: F.col(source_col)}.values(), *([] if members is None else [members.alias("__members")]))
    out = _ranked(own, None if members is None else F.col("__members"), id_col, text_col, source_col, weights, repeats, seed, True)
    return out.select(
        F.col(id_col).alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__times").alias("times"), (F.col("__size") * F.col("__times")).alias("taken"),
    )


def mixture(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """``docs`` as ``mix`` takes them: each row as many times as it is taken, with its own columns."""
    plain, names = numbered(docs if members is None else docs.withColumn("__members", members))
    held = None if members is None else F.col(names.pop("__members"))
    out = _ranked(plain, held, names[id_col], names[text_col], names[source_col], weights, repeats, seed, False).filter("__times > 0")
    return renamed(out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))), names)


def _fill_group(pdf: pd.DataFrame) -> pd.DataFrame:
    units = sorted(zip(pdf["rank"].tolist(), pdf["w"].tolist(), strict=True))
    chosen = sorted(fill(units, float(pdf["gap"].iloc[0])))
    return pd.DataFrame({"key": pdf["key"].iloc[0], "rank": pd.Series(chosen, dtype="int64")})


def _cut(numbers: DataFrame, plan: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, low): all units of a pattern with a rank below are taken; (key, rank): those taken in the boundary from there on.

    Each pass counts words and units in 1,024 bins of the ranks in question, for all patterns with a gap at once. A
    boundary ends with at most BOUNDARY_DOCS units on each side of its cut, or with one rank. At most six passes.
    """
    units = numbers.filter("__size > 0").select(F.col("__key").alias("key"), F.col("__rank").alias("rank"), F.col("__size").alias("w"))
    open_ = materialise(plan.filter("gap > 0").select("key", "n", F.lit(0).cast("long").alias("first"), F.col("gap").alias("left")), "mix-open")
    bits, ends = _RANK_BITS, []
    by_bin = Window.partitionBy("key").orderBy("bin")
    while bits and not open_.isEmpty():
        step = max(bits - _BIN_BITS, 0)
        inside = _joined(units, open_.select("key", "n", "first"), "key", rows).filter((F.col("rank") >= F.col("first")) & (F.shiftright(F.col("rank") - F.col("first"), bits) == 0))
        counts = inside.groupBy("key", F.shiftright(F.col("rank") - F.col("first"), step).cast("int").alias("bin")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("m"))
        bins = materialise(counts.withColumns({"cw": F.sum("w").over(by_bin), "cm": F.sum("m").over(by_bin)}), "mix-bins")
        # The cut: the first bin that the gap doesn't fill, or the last one.
        over = open_.join(bins, "key").withColumn("beyond", F.col("cw") > F.col("left"))
        cut = over.groupBy("key").agg(
            F.first("n").alias("n"), F.first("first").alias("first"), F.first("left").alias("left"),
            F.coalesce(F.min(F.when(F.col("beyond"), F.struct("bin", "w", "m", "cw", "cm"))), F.max(F.struct("bin", "w", "m", "cw", "cm"))).alias("at"),
        )
        cut = materialise(cut, "mix-cut-bins")
        deeper = (F.col("at.m") > BOUNDARY_DOCS) & F.lit(step > 0)
        near = cut.filter(~deeper).join(bins, "key").filter(
            ((F.col("bin") <= F.col("at.bin")) & (F.col("at.cm") - F.col("cm") + F.col("m") <= F.greatest(F.col("at.m"), F.lit(BOUNDARY_DOCS))))
            | ((F.col("bin") > F.col("at.bin")) & (F.col("cm") - F.col("at.cm") <= BOUNDARY_DOCS))
        )
        start = F.col("first") + F.shiftleft(F.min("bin").cast("long"), step)
        edge = near.groupBy("key", "n", "first", "left").agg(
            start.alias("low"), (F.col("first") + F.shiftleft(F.max("bin").cast("long") + 1, step) - 1).alias("high"), (F.col("left") - F.min(F.col("cw") - F.col("w"))).alias("gap")
        )
        ends.append(materialise(edge.select("key", "n", "low", "high", "gap"), "mix-edges"))
        again = cut.filter(deeper).select("key", "n", (F.col("first") + F.shiftleft(F.col("at.bin").cast("long"), step)).alias("first"), (F.col("left") - F.col("at.cw") + F.col("at.w")).alias("left"))
        again = materialise(again, "mix-open")
        for done in (open_, bins, cut):
            release(done)
        open_, bits = again, step
    spark = numbers.sparkSession
    if not ends:
        return spark.createDataFrame([], "key string, low long"), spark.createDataFrame([], "key string, rank long")
    edges = ends[0]
    for more in ends[1:]:
        edges = edges.unionByName(more)
    edges = materialise(edges, "mix-boundaries")
    around = _joined(units, edges, "key", rows).filter("rank between low and high").groupBy("key", "rank", "gap").agg(F.sum("w").alias("w"))
    picked = materialise(around.groupBy("key").applyInPandas(_fill_group, "key string, rank long"), "mix-picked")
    for done in ends:
        release(done)
    return edges.select("key", "low"), picked
