"""String constants by the scopes in which Java looks a name up.

A name used in a class means the first constant of that name, in order: the class's own, those of its supertypes depth
first, the same for each class around it from the inside out, then those of statically imported classes and their
supertypes. ``Owner.NAME`` looks at the owner and its supertypes alone.

Tables: ``types`` repo, type, outer (null: none); ``supers`` repo, type, ord, parent; ``imports`` repo, type, ord, owner, name
(static imports that the type's file has; null: all names); ``constants`` repo, type, name, parts: array<struct<literal,
ref, owner>>, the summands of the value, each a text, a name or a name of an owner. Types go by their whole names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators.extract import resolve_constants
from seamline.plans.lineage import Pile, stored

#: Sorts imported classes behind all those around a class.
_IMPORTED = 1 << 30


def ancestors(types: DataFrame, supers: DataFrame) -> DataFrame:
    """(repo, type, holder, way): each type and its known supertypes; ``way``, the positions of the steps up, sorts them depth first.

    One that is met on several ways keeps the first, and a way that comes to a type again ends.
    """
    known = types.select("repo", "type").distinct()
    ups = stored(supers.select("repo", F.col("type").alias("holder"), F.col("ord").cast("int").alias("ord"), "parent").join(known.withColumnRenamed("type", "parent"), ["repo", "parent"], "left_semi"))
    found = Pile(types.sparkSession)
    fresh = found.add(known.select("repo", "type", F.col("type").alias("holder"), F.array().cast("array<int>").alias("way"), F.array("type").alias("met")))
    while not fresh.isEmpty():
        step = fresh.join(ups, ["repo", "holder"]).where(~F.array_contains("met", F.col("parent")))
        fresh = found.add(step.select("repo", "type", F.col("parent").alias("holder"), F.concat("way", F.array("ord")).alias("way"), F.concat("met", F.array("parent")).alias("met")))
    return found.rows().groupBy("repo", "type", "holder").agg(F.min("way").alias("way"))


def around(types: DataFrame) -> DataFrame:
    """(repo, type, scope, level): each type at level 0 and those around it, from the inside out."""
    outer = stored(types.where("outer IS NOT NULL").select("repo", F.col("type").alias("scope"), "outer").distinct())
    found = Pile(types.sparkSession)
    fresh = found.add(types.select("repo", "type", F.col("type").alias("scope"), F.lit(0).alias("level"), F.array("type").alias("met")).distinct())
    while not fresh.isEmpty():
        step = fresh.join(outer, ["repo", "scope"]).where(~F.array_contains("met", F.col("outer")))
        fresh = found.add(step.select("repo", "type", F.col("outer").alias("scope"), (F.col("level") + 1).alias("level"), F.concat("met", F.array("outer")).alias("met")))
    return found.rows().drop("met")


def targets(types: DataFrame, supers: DataFrame, imports: DataFrame, uses: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, type, owner, ref, holder): the class whose constant each use (repo, type, owner, ref) means; uses without one are left out.

    Only the scopes of names in use are laid out, and only classes that declare the name are kept.
    """
    up = stored(ancestors(types, supers))
    free = uses.where("owner IS NULL").select("repo", "type", "ref").distinct()
    inner = free.join(around(types), ["repo", "type"]).select("repo", "type", F.lit(None).cast("string").alias("owner"), "ref", "scope", "level")
    taken = free.join(imports.where("name IS NULL").drop("name"), ["repo", "type"]).unionByName(free.join(imports.withColumnRenamed("name", "ref"), ["repo", "type", "ref"]))
    static = taken.select("repo", "type", F.lit(None).cast("string").alias("owner"), "ref", F.col("owner").alias("scope"), (F.col("ord").cast("int") + _IMPORTED).alias("level"))
    named = uses.where("owner IS NOT NULL").select("repo", "type", "owner", "ref", F.col("owner").alias("scope"), F.lit(0).alias("level")).distinct()
    scopes = inner.unionByName(static).unionByName(named).join(up.withColumnRenamed("type", "scope"), ["repo", "scope"])
    met = scopes.join(declared.select("repo", F.col("type").alias("holder"), F.col("name").alias("ref")).distinct(), ["repo", "holder", "ref"])
    return met.groupBy("repo", "type", "owner", "ref").agg(F.min_by("holder", F.struct("level", "way")).alias("holder"))


def scoped_constants(types: DataFrame, supers: DataFrame, imports: DataFrame, constants: DataFrame, steps: int = 16) -> DataFrame:
    """(repo, type, name, value): each constant's text, ``<expr>`` where a name in it has no constant, comes back to itself or lies more than ``steps`` deep.

    Of constants that repeat a (type, name) the least by parts counts; those without parts (no initial value) don't count
    as declared. Where to look is found for each name once; the values are then put in from the leaves up.
    """
    own = stored(constants.where("repo IS NOT NULL AND type IS NOT NULL AND name IS NOT NULL AND size(parts) > 0").groupBy("repo", "type", "name").agg(F.min("parts").alias("parts")))
    parts = own.select("repo", "type", "name", F.posexplode("parts").alias("i", "p")).select("repo", "type", "name", "i", "p.literal", "p.ref", "p.owner")
    uses = parts.where("ref IS NOT NULL").select("repo", "type", "owner", "ref").distinct()
    key = lambda t, n: F.concat_ws("#", t, n)
    found = targets(types, supers, imports, uses, own).withColumnRenamed("owner", "_owner").withColumnsRenamed({"type": "_type", "repo": "_repo", "ref": "_ref"})
    same = (F.col("repo") == F.col("_repo")) & (F.col("type") == F.col("_type")) & (F.col("ref") == F.col("_ref")) & F.col("owner").eqNullSafe(F.col("_owner"))
    bound = parts.join(found, same, "left")
    # a name without a target stays a reference to nothing
    aim = F.when(F.col("ref").isNotNull(), F.when(F.col("holder").isNull(), F.lit("#")).otherwise(key("holder", "ref")))
    part = F.struct(F.when(F.col("ref").isNull(), F.coalesce("literal", F.lit(""))).alias("literal"), aim.alias("ref"))
    rows = bound.select("repo", key("type", "name").alias("name"), "i", part.alias("part")).groupBy("repo", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]).alias("parts"))
    values = resolve_constants(stored(rows), steps)
    return values.select("repo", F.substring_index("name", "#", 1).alias("type"), F.substring_index("name", "#", -1).alias("name"), "value")
