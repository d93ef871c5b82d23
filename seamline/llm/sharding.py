"""Sharding by a permutation-filled lookup table.

Shards take turns; at its turn a shard claims, of the slots that are still free, the one that stands first in its own
preference order. The order of a shard is the permutation ``(offset + k * skip) mod size`` of a prime-sized table, with
offset and skip from the shard's name. A row goes to the shard of slot ``hash(key) mod size``: one lookup, and a
changed set of shards moves few rows beyond those that must move.

Only DataFrame and SQL functions are used. The table has ``size`` rows, a parameter that doesn't depend on the input
(4801 rows of two integers by default), which is the proof that it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; at 48 shards each gets 100 or 101 slots.
SIZE = 4801
SHARDS = 48
#: Places of a shard's order that a turn looks at first.
PROBES = 64


def digits(text: Column, first: int) -> Column:
    """A number of 60 bits from 15 hexadecimal digits of the MD5 digest."""
    return F.conv(F.substring(F.md5(text), first, 15), 16, 10).cast("long")


def preferences(names: DataFrame, size: int = SIZE) -> DataFrame:
    """(turn, shard, offset, skip) of each distinct shard name, in turn order: by name."""
    shards = names.select(F.col(names.columns[0]).cast("string").alias("shard")).where("shard IS NOT NULL").distinct()
    ordered = shards.agg(F.array_sort(F.collect_list("shard")).alias("all")).select(F.posexplode("all").alias("turn", "shard"))
    skip = F.pmod(digits(F.col("shard"), 16), F.lit(size - 1)) + 1
    return ordered.select("turn", "shard", F.pmod(digits(F.col("shard"), 1), F.lit(size)).alias("offset"), skip.alias("skip"))


def put(items: Column, at: Column, value: Column) -> Column:
    """The array with ``value`` at index ``at``."""
    return F.concat(F.slice(items, F.lit(1), at), F.array(value), F.slice(items, at + 2, F.size(items)))


def lookup_table(names: DataFrame, size: int = SIZE) -> DataFrame:
    """(slot, shard): every slot of the table, claimed in turns. ``size`` must be prime. No shard: no row.

    The filling is one fold over ``size`` turns in one row of bounded size. Each shard keeps a cursor in its order and
    goes on from there, so that a shard looks at each place of its order once, but for the rest of its last PROBES.
    At most ``size`` shards get slots.
    """
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be prime, not {size}")
    row = preferences(names, size).agg(F.array_sort(F.collect_list(F.struct("turn", "shard", "offset", "skip"))).alias("p"))
    row = row.where(F.size("p") > 0)

    word = lambda slot: F.floor(slot / 64).cast("int")  # noqa: E731  free slots are kept as bits, 64 to a word

    def first_free(state: Column, own: Column, start: Column, count: int) -> Column:
        """(at, slot) of the first place with a free slot among ``count`` places of the shard's order, or null."""
        places = F.transform(F.sequence(start, F.least(start + (count - 1), F.lit(size - 1).cast("long"))), lambda k: F.struct(k.alias("at"), ((own["offset"] + k * own["skip"]) % size).alias("slot")))
        return F.get(F.filter(places, lambda x: F.bit_get(F.get(state["free"], word(x["slot"])), (x["slot"] % 64).cast("int")) == 1), F.lit(0))

    def step(state: Column, turn: Column) -> Column:
        # the optimizer may fold before it drops the row of no shards
        which = (turn % F.greatest(F.size("p"), F.lit(1))).cast("int")
        own, start = F.get("p", which), F.get(state["cursor"], which)
        # far ahead only where all near places are taken
        near = F.coalesce(*(first_free(state, own, start, n) for n in (PROBES, 16 * PROBES, size)))
        # what was found is computed once, as an array of one element that transform() binds to a name
        claim = lambda c: F.struct(
            put(state["free"], word(c["slot"]), F.get(state["free"], word(c["slot"])).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (c["slot"] % 64).cast("int")))).alias("free"), put(state["cursor"], which, c["at"] + 1).alias("cursor"), F.concat(state["taken"], F.array(c["slot"])).alias("taken")
        )
        return F.get(F.transform(F.array(near), claim), F.lit(0))

    zero = F.lit(0).cast("long")
    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), size // 64 + 1).alias("free"), F.transform("p", lambda _: zero).alias("cursor"), F.array().cast("array<bigint>").alias("taken"))
    filled = row.select("p", F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step, lambda s: s["taken"]).alias("taken"))
    return filled.select("p", F.posexplode("taken").alias("turn", "slot")).select("slot", F.get("p", F.col("turn") % F.size("p"))["shard"].alias("shard"))


def place(df: DataFrame, table: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard``; columns of these names are replaced.

    The key is hashed as text, null as the empty text, so all rows of a key meet on one shard. The table is broadcast:
    it has ``size`` rows. Nothing is shuffled, so neither hot keys nor repeated rows matter.
    """
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    value = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = df.withColumn("slot", F.pmod(digits(value, 1), F.lit(size)))
    if "shard" in placed.columns:
        placed = placed.drop("shard")
    return placed.join(F.broadcast(table), "slot", "left").select(*kept, "slot", "shard")


def shard_names(spark: SparkSession, n: int = SHARDS) -> DataFrame:
    return spark.range(n).select(F.format_string("shard-%04d", "id").alias("shard"))


#: DuckDB: the same table and placement.
ORACLE = f"""
WITH names AS (SELECT printf('shard-%04d', i) AS shard FROM range({SHARDS}) t(i)),
prefs AS (
  SELECT shard, ('0x' || substr(md5(shard), 1, 15))::BIGINT % {SIZE} AS off,
         ('0x' || substr(md5(shard), 16, 15))::BIGINT % {SIZE - 1} + 1 AS skip FROM names),
inv AS (
  SELECT shard, off, list_filter(range(1, {SIZE}), lambda x: (x * skip) % {SIZE} = 1)[1] AS inverse FROM prefs),
p AS (SELECT list(shard ORDER BY shard) AS shards, list(off ORDER BY shard) AS offs, list(inverse ORDER BY shard) AS invs FROM inv),
filled AS (
  SELECT shards, list_reduce(range(0, {SIZE}),
    lambda s, t: list_transform([list_min(list_transform(s[1], lambda x: (((x - offs[t % len(shards) + 1]) * invs[t % len(shards) + 1]) % {SIZE} + {SIZE}) % {SIZE} * {SIZE} + x)) % {SIZE}],
                                lambda c: [list_filter(s[1], lambda x: x <> c), list_append(s[2], c)])[1],
    [range(0, {SIZE}), []::BIGINT[]])[2] AS taken FROM p),
slots AS (SELECT unnest(taken) AS slot, shards[(generate_subscripts(taken, 1) - 1) % len(shards) + 1] AS shard FROM filled)
SELECT d.doc_id, s.slot, s.shard
FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SIZE} AS slot FROM documents) d JOIN slots s USING (slot)
"""
