"""URL filtering by a cascade of Bloom filters.

Listed keys (rules and blocked hosts) are looked up among a url's candidate keys: each suffix of its host that is no
longer than the longest listed host, alone and with each prefix of its path that is as long as some rule's path. The
candidates of all pages are the complete key universe, written once as distinct hashes, so membership can be made exact:
level 0 encodes the listed keys, level 1 the unlisted candidates that pass level 0, level 2 the listed keys that pass
level 1, and so on until nothing passes wrongly. A lookup walks the levels; the first level that a key fails decides by
its parity. No join is needed to answer, only the filters.

A key is asked once for each action, as a hash of both, so that one cascade answers for all actions. A list too large
for one task's memory is dealt into shards by hash, each with a cascade of its own over its share of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, materialise, only

#: The most bytes of all levels of a cascade that are sent to executors at once.
MAX_FILTER_BYTES = 64 << 20
#: A cascade of so few bytes is never dealt into shards.
LEAST_BYTES = 64
MAX_LEVELS = 64
ACTIONS = ("block", "allow")

#: Rules (host and path prefix, action): fixed values of the registered query.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts that are blocked with all their subdomains where no rule fits: the junk families that the test pages name.
BLOCKED_HOSTS = tuple(
    f"{name}.example.{end}" for name in ("spam-farm", "cheap-pills", "free-bets", "adult-x", "casino-win", "ads-track") for end in ("com", "net", "org")
)

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Level:
    """One Bloom filter over 128-bit key hashes; each level has probes of its own."""

    def __init__(self, number: int, n: int, rate: float):
        self.number = number
        self.bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.probes = max(1, round(-math.log2(rate)))
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def at(self, h1: np.ndarray, h2: np.ndarray, k: int) -> np.ndarray:
        salt = np.uint64((self.number * 64 + k + 1) * int(_MIX[0]) & (1 << 64) - 1)
        return _scramble(h1 ^ _scramble(h2 + salt)) % np.uint64(self.bits)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return np.concatenate([self.at(h1, h2, k) for k in range(self.probes)]) if len(h1) else np.zeros(0, dtype=np.uint64)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for k in range(self.probes):
            at = self.at(h1, h2, k)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe it was built over."""
        listed = np.zeros(len(h1), dtype=bool)
        walk = np.arange(len(h1))
        for n, level in enumerate(self.levels):
            walk = walk[level.passes(h1[walk], h2[walk])]
            listed[walk] = n % 2 == 0
            if not len(walk):
                break
        return listed


def key_hash(key: Column, action: str) -> list[Column]:
    """128 bits of a key asked for an action."""
    return [F.xxhash64(F.lit(action), key), F.xxhash64(F.lit(0x5EED), F.lit(action), key)]


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _encode(keys: DataFrame, level: Level) -> None:
    """Fill the level: set bits are combined by word on the executors, a word at a time reaches the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.positions(_unsigned(batch.column(0)), _unsigned(batch.column(1))))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.diff(word, prepend=np.uint64((1 << 64) - 1)))
            ored = np.bitwise_or.reduceat(bit, first) if len(at) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(ored.view(np.int64))], names=["word", "bits"])

    for r in keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        level.words[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.passes(_unsigned(batch.column(0)), _unsigned(batch.column(1)))))

    return keys.mapInArrow(keep, "h1 long, h2 long")


def build(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """(h1, h2) of the distinct listed keys and of all keys that will ever be asked; None if the filters would outgrow ``max_bytes``.

    Which keys pass level 0 wrongly is found by comparing those alone with the list: that comparison makes the answers exact.
    """
    n = listed.count()
    if not n:
        return Cascade([])
    asked = universe.agg(F.approx_count_distinct(F.struct("h1", "h2"))).first()[0]
    # Level 0 lets through about as many strangers as there are listed keys; each later level halves.
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(asked - n, n)))
    levels, inside, outside, used = [], listed, universe, 0
    for number in range(MAX_LEVELS):
        level = Level(number, n, rate if number == 0 else 0.5)
        used += level.bits // 8
        if used > max(max_bytes, LEAST_BYTES):
            return None
        _encode(inside, level)
        levels.append(level)
        wrong = _passing(outside, level)
        if number == 0:
            wrong = wrong.join(listed, ["h1", "h2"], "left_anti")
        wrong = materialise(wrong, "passing-keys")
        n = wrong.count()
        if not n:
            return Cascade(levels)
        inside, outside = wrong, inside
    raise ValueError("the cascade did not end: two keys share a 128-bit hash")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; path from there to ``? #`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def candidates(host: Column, path: Column, lengths: list[int], labels: int, longest: int) -> Column:
    """All keys a url may be listed by, longest first; ``lengths``: of the rules' paths (0: the host alone).

    ``labels``, ``longest``: the most labels and characters of a listed host; longer suffixes can't be listed, and a host of
    any length gives at most ``labels`` of them.
    """
    parts = F.split(host, r"\.")
    room = F.length(path)

    def keys(p: Column) -> Column:
        suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(p))), lambda k: F.array_join(F.slice(p, F.size(p) - k + 1, k), "."))
        short = F.filter(suffixes, lambda s: F.length(s) <= longest)
        return F.flatten(F.transform(short, lambda s: F.filter(F.array(*[
            F.when(room >= n, F.struct((F.length(s) + n).alias("n"), F.length(s).alias("hn"), F.concat(s, F.left(path, F.lit(n))).alias("key"), F.lit(n > 0).alias("rule")))
            for n in lengths]), lambda x: x.isNotNull())))

    none = F.array().cast("array<struct<n:int,hn:int,key:string,rule:boolean>>")
    return F.when(host == "", none).otherwise(F.reverse(F.array_sort(let(parts, keys))))


def _judge(batches: Iterator[pa.RecordBatch], cascade: Cascade, shard: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Append the place of the first listed candidate of the shard with a rule (or -1), its action, and whether any host alone is blocked."""
    for batch in batches:
        hashes, names = batch.column(batch.schema.get_field_index("hashes")), batch.schema.names
        flat = hashes.flatten()
        rule = flat.field(4).to_numpy(zero_copy_only=False)
        listed = []
        for k in range(2):
            h1, h2 = _unsigned(flat.field(2 * k)), _unsigned(flat.field(2 * k + 1))
            own = np.flatnonzero(shard_of(h1, shards) == shard)
            found = np.zeros(len(h1), dtype=bool)
            found[own] = cascade.member(h1[own], h2[own])
            listed.append(found)
        blocked, allowed = listed
        offsets = hashes.offsets.to_numpy().astype(np.int64) - hashes.offsets[0].as_py()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        place, action, host = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows, dtype=bool)
        hit = np.flatnonzero(rule & (blocked | allowed))[::-1]  # from behind: the first of a row is written last
        place[rows[hit]] = hit - offsets[rows[hit]]
        action[rows[hit]] = blocked[hit]
        host[rows[np.flatnonzero(~rule & blocked)]] = True
        rest = [batch.column(i) for i, n in enumerate(names) if n != "hashes"]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(place, pa.int32()), pa.array(action), pa.array(host)], names=[*[n for n in names if n != "hashes"], "place", "rule_blocks", "host_blocked"]
        )


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """A key's shard: the upper 31 bits of its first hash, modulo the number of shards."""
    return (h1 >> np.uint64(33)) % np.uint64(shards)


def judge(pages: DataFrame, rules: tuple = RULES, blocked_hosts: DataFrame | tuple = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url",
          max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    The longest rule (host and path prefix) that fits decides; where none fits, a url is blocked if its host or a parent of
    it is among ``blocked_hosts``, a tuple or a DataFrame with a column ``host`` of any size. A url that is null or has no
    ``://`` has empty host and path and is allowed. Repeated rows stay; null ids stay null. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    hosts = blocked_hosts if isinstance(blocked_hosts, DataFrame) else spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    hosts = hosts.select("host").filter("host is not null and host <> ''")
    lengths = sorted({len(r) - r.index("/") for r, _ in rules} | {0})
    widest = hosts.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("host")).alias("longest")).first()
    own_hosts = [r[: r.index("/")] for r, _ in rules]
    labels = max([1, widest["labels"] or 1, *(h.count(".") + 1 for h in own_hosts)])
    longest = max([1, widest["longest"] or 1, *map(len, own_hosts)])
    own = only(pages, id_col, url_col).toDF("page_id", "url")
    host, path = split_url(F.col("url"))
    keyed = own.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), lengths, labels, longest))

    def hashed(df: DataFrame, action: str) -> DataFrame:
        return df.select(*[h.alias(n) for h, n in zip(key_hash(F.col("key"), action), ("h1", "h2"), strict=True)])

    # A rule's key ends in its path; a bare host can't be mistaken for one, as every rule holds a slash.
    listed = hashed(hosts.select(F.col("host").alias("key")), "block")
    for action in ACTIONS:
        listed = listed.unionAll(hashed(spark.createDataFrame([(r,) for r, a in rules if a == action], "key string"), action))
    listed = materialise(listed.distinct(), "listed-keys")
    asked = keyed.select(F.explode("keys").alias("x")).select(F.col("x.key").alias("key")).distinct()
    universe = materialise(hashed(asked, "block").unionAll(hashed(asked, "allow")), "asked-keys")
    one = F.transform("keys", lambda x: F.struct(
        *[h.alias(f"{a}{n}") for a in ACTIONS for h, n in zip(key_hash(x["key"], a), (1, 2), strict=True)], x["rule"].alias("rule")))
    rows = keyed.select("page_id", "host", "path", F.transform("keys", lambda x: x["key"]).alias("keys"), one.alias("hashes"))
    kind = dict(pages.dtypes)[id_col]
    cascade = build(listed, universe, max_bytes)
    if cascade is not None:
        schema = f"page_id {kind}, host string, path string, keys array<string>, place int, rule_blocks boolean, host_blocked boolean"
        return _verdicts(rows.mapInArrow(lambda it: _judge(it, cascade, 0, 1), schema))
    return _verdicts(_sharded(rows, listed, universe, max_bytes, kind))


def _verdicts(judged: DataFrame) -> DataFrame:
    fits = F.col("place") >= 0
    blocks = F.when(fits, F.col("rule_blocks")).otherwise(F.col("host_blocked"))
    return judged.select("page_id", "host", "path", F.get("keys", F.when(fits, F.col("place"))).alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))


def _sharded(rows: DataFrame, listed: DataFrame, universe: DataFrame, max_bytes: int, kind: str) -> DataFrame:
    """Rows judged by one cascade after another, each over its shard of the keys; a row's first rule and blocked hosts add up."""
    shards = 2
    shard = lambda df, k: df.filter(F.shiftrightunsigned("h1", 33) % shards == k)
    while True:
        cascades = []
        for k in range(shards):
            cascades.append(build(shard(listed, k), shard(universe, k), max_bytes))
            if cascades[-1] is None:
                break
        if cascades[-1] is not None:
            break
        shards *= 2
    schema = f"page_id {kind}, host string, path string, keys array<string>, hashes array<struct<block1:bigint,block2:bigint,allow1:bigint,allow2:bigint,rule:boolean>>"
    first = F.least(F.when(F.col("best") >= 0, F.col("best")), F.when(F.col("place") >= 0, F.col("place")))
    done = rows.withColumns({"best": F.lit(-1), "best_blocks": F.lit(False), "any_host": F.lit(False)})
    for k, cascade in enumerate(cascades):  # each pass needs one cascade in memory; the rows flow through without a shuffle
        step = done.mapInArrow(_judger(cascade, k, shards), f"{schema}, best int, best_blocks boolean, any_host boolean, place int, rule_blocks boolean, host_blocked boolean")
        better = (F.col("place") >= 0) & ((F.col("best") < 0) | (F.col("place") < F.col("best")))
        done = materialise(step.select(
            "page_id", "host", "path", "keys", "hashes", F.coalesce(first, F.lit(-1)).alias("best"),
            F.when(better, F.col("rule_blocks")).otherwise(F.col("best_blocks")).alias("best_blocks"), (F.col("any_host") | F.col("host_blocked")).alias("any_host"),
        ), "judged-pages")
    return done.select("page_id", "host", "path", "keys", F.col("best").alias("place"), F.col("best_blocks").alias("rule_blocks"), F.col("any_host").alias("host_blocked"))


def _judger(cascade: Cascade, shard: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("hashes")
            yield from (judged.add_column(at, batch.schema.field(at), batch.column(at)) for judged in _judge(iter([batch]), cascade, shard, shards))

    return run
