"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size byte blocks. Sorting the blocks gives equal blocks one integer name; adjacent
names are then paired and the pairs named in the same way, level by level, until each text has one name. Two texts
have the same (level, name) exactly if their bytes are equal: names come from comparing contents, never from hashes.
A hash only says which task compares a block.

Scale: contents are shuffled once, at the first level; from then on rows hold integers, and their number halves with
each level. A block that many texts share is spread over several tasks (salted by its measured count), and the few
names it got there are merged afterwards. Higher levels name aggregated pairs, so that a frequent pair is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import let, materialise, numbered, only, partitions, release, renamed

#: Bytes of a block; a constant of the method.
BLOCK_BYTES = 8192


def _named(blocks: DataFrame) -> DataFrame:
    """One name for the equal (h, salt, block) of a partition; the row that gave the name keeps its block in ``rep`` if its group is salted.

    Blocks are sorted and compared where the shuffle left them: Spark's sort spills, and a group is at most a hot block's share of a task.
    """
    name = F.min("row").over(Window.partitionBy("h", "salt", "block"))
    rep = F.when((F.col("salt") > 0) & (F.col("row") == F.col("name")), F.col("block"))
    rows = blocks.withColumn("row", F.monotonically_increasing_id()).withColumn("name", name)
    return rows.select("doc_id", "text_sha256", "n", "pos", "name", rep.alias("rep"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, made: list[DataFrame] | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_sha256, level, name, copies (repeated rows). ``made`` gets the tables that the result reads."""
    made = [] if made is None else made
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    base = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("int")
    sizes = base.agg(F.sum(size).alias("n"), F.max(size).alias("longest")).first()
    total = sizes["n"] or 0
    cut = let(
        F.col("text").cast("binary"),
        lambda b: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes))),
    )
    blocks = base.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), size.alias("n"), F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("h", F.xxhash64("block"))

    # Blocks so frequent that one of them would outgrow a task: at most 8 * parts, so the list is small at any scale.
    heavy = max(64, total // (8 * parts))
    only_h = base.select(F.explode(F.transform(cut, lambda b: F.xxhash64(b))).alias("h"))
    hot = only_h.groupBy("h").count().filter(F.col("count") >= heavy).collect()
    hot_df = spark.createDataFrame([(r["h"], 1 + r["count"] // heavy) for r in hot], "h long, salts long")
    salted = blocks.join(F.broadcast(hot_df), "h", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id", "pos", "text_sha256"), F.col("salts"))).cast("int")
    )
    dealt = salted.select("doc_id", "text_sha256", "n", "pos", "block", "h", "salt").repartition(parts, "h", "salt")
    named = materialise(_named(dealt), "block-names")
    made.append(named)
    # Merge what salting split: a hot block has one name per salt, 16 * parts names in all at most.
    reps = named.filter(F.col("rep").isNotNull()).select("rep", "name")
    merged = reps.join(reps.groupBy("rep").agg(F.min("name").alias("canon")), "rep").select("name", "canon")
    if hot:
        named = named.join(F.broadcast(merged), "name", "left").withColumn("name", F.coalesce("canon", "name"))
    level_rows = named.select("doc_id", "text_sha256", "n", "pos", "name", F.lit(1).alias("copies"))

    key = ["doc_id", "text_sha256"]
    done = [level_rows.filter("n = 1").select(*key, F.lit(0).alias("level"), "name", F.col("copies").cast("long").alias("copies"))]
    level, rows = 0, level_rows.filter("n > 1")
    longest = sizes["longest"] or 1
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = rows.groupBy(*key, (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max("n").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.sum(F.when(even, F.col("copies"))).alias("copies"),
        )
        pairs = materialise(pairs, "block-pairs")
        names = materialise(pairs.select("a", "b").distinct().withColumn("name", F.monotonically_increasing_id()), "pair-names")
        made += [pairs, names]
        rows = pairs.join(names, ["a", "b"]).select(*key, ((F.col("n") + 1) / 2).cast("int").alias("n"), "pos", "name", "copies")
        done.append(rows.filter("n = 1").select(*key, F.lit(level).alias("level"), "name", "copies"))
        rows = rows.filter("n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy(*key, "level", "name").agg(F.sum("copies").cast("long").alias("copies"))


#: A row that is repeated more often is first dealt out in runs of so many copies.
RUN = 65_536


def _repeated(rows: DataFrame, most: int) -> DataFrame:
    """Each row ``copies`` times, with its number in ``nth``; no array is longer than RUN or a RUN-th of the copies."""
    if most <= RUN:
        return rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))
    dealt = rows.withColumn("run", F.explode(runs)).repartition(partitions(rows.sparkSession))
    last = F.least(F.col("copies"), (F.col("run") + 1) * RUN)
    return dealt.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN + 1, last))).drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the largest doc_id stays; of fully repeated rows (same id and text) one stays, and
    all carry the same keep_id. Null texts count as empty, and empty texts are equal. A null id is kept only if its
    whole group has null ids. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    made: list[DataFrame] = []
    ids = materialise(identities(docs, id_col, text_col, block_bytes, made), "text-names")
    for done in made:  # the names of blocks and pairs are in the table just written
        release(done)
    # Written, so that the join below shares no shuffle with the aggregation and Spark can split the tasks of a large group.
    groups = materialise(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "text-groups")
    rows = _repeated(ids.join(groups, ["level", "name"]), ids.agg(F.max("copies")).first()[0] or 0)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "level", "name")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of repeated rows one stays."""
    key = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("i"), F.col(c).cast("string")))  # noqa: E731  a null-safe key that is plain equality
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("text_sha256").alias("__sha"), key("doc_id").alias("__id"))
    plain, names = numbered(docs)
    own = plain.withColumn("__sha", F.sha2(F.coalesce(F.col(names[text_col]), F.lit("")), 256)).withColumn("__id", key(names[id_col]))
    return renamed(own.join(kept, ["__sha", "__id"], "left_semi").dropDuplicates(["__sha", "__id"]), names)
