"""DTO fields through supertypes: a closure that carries what the type parameters above stand for.

Each step up a supertype puts the subclass's arguments into the parent's parameters, so fields of any ancestor are
expressed in the parameters of the class that is asked for. The members met on the way are then folded by precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.paths import getter_property, rename
from seamline.plans.lineage import Pile, stored

STRATEGIES = ("snake", "kebab", "dot", "upper_camel", "lower")
#: Sorts a class behind its supertypes.
_OWN = (1 << 31) - 1


def parameter(name: Column) -> Column:
    return F.concat(F.lit('{"kind":"typeParameter","name":"'), name, F.lit('"}'))


def substitute(type_json: Column, parameters: Column, args: Column) -> Column:
    """``type_json`` with the i-th argument for the i-th parameter, all at once: an argument may name the same parameters.

    A parameter without an argument stays.
    """
    each = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parameters) - 1))
    slot = lambda i: F.concat(F.lit('{"slot":'), i.cast("string"), F.lit("}"))
    bound = lambda i: (i < F.size(parameters)) & F.get(args, i).isNotNull()
    marked = F.aggregate(each, type_json, lambda acc, i: F.when(bound(i), F.replace(acc, parameter(F.get(parameters, i)), slot(i))).otherwise(acc))
    return F.aggregate(each, marked, lambda acc, i: F.when(bound(i), F.replace(acc, slot(i), F.get(args, i))).otherwise(acc))


def lineages(classes: DataFrame, extends: DataFrame) -> DataFrame:
    """(repo, dto_id, ancestor, env, naming, place): each class and, once each, its ancestors that are known.

    ``env``: what the ancestor's parameters stand for, in those of the class. ``naming``: the ancestor's own strategy, else
    that of the nearest class on the way down. ``place`` orders ancestors before what extends them, by supertype position;
    of several ways up the first by position counts, and a way that comes to a class again ends.

    ``classes``: repo, dto_id, type_parameters, naming; ``extends``: repo, dto_id, ord, parent, args (types in the class's
    parameters, null for a raw one).
    """
    known = stored(classes.select("repo", F.col("dto_id").alias("ancestor"), "type_parameters", F.col("naming").alias("_naming")))
    ups = stored(extends.select("repo", F.col("dto_id").alias("ancestor"), "ord", "parent", "args").join(known.select("repo", F.col("ancestor").alias("parent")), ["repo", "parent"], "left_semi"))
    markers = F.transform("type_parameters", parameter)
    found = Pile(classes.sparkSession)
    fresh = found.add(known.select("repo", F.col("ancestor").alias("dto_id"), "ancestor", markers.alias("env"), F.col("_naming").alias("naming"), F.array().cast("array<int>").alias("way"), F.array("ancestor").alias("met")))
    while not fresh.isEmpty():
        above = fresh.join(known.select("repo", "ancestor", "type_parameters"), ["repo", "ancestor"]).join(ups, ["repo", "ancestor"]).where(~F.array_contains("met", F.col("parent")))
        args = F.transform(F.coalesce("args", F.array()), lambda a: substitute(a, F.col("type_parameters"), F.col("env")))
        step = above.select("repo", "dto_id", F.col("parent").alias("ancestor"), args.alias("env"), F.col("naming").alias("_below"), F.concat("way", F.array(F.col("ord").cast("int"))).alias("way"), F.concat("met", F.array("parent")).alias("met"))
        fresh = found.add(step.join(known.select("repo", "ancestor", "_naming"), ["repo", "ancestor"]).select("repo", "dto_id", "ancestor", "env", F.coalesce("_naming", "_below").alias("naming"), "way", "met"))
    first = found.rows().groupBy("repo", "dto_id", "ancestor").agg(F.min(F.struct("way", "env", "naming")).alias("f"))
    return first.select("repo", "dto_id", "ancestor", "f.env", "f.naming", F.concat("f.way", F.array(F.lit(_OWN))).alias("place"))


def flatten_fields(classes: DataFrame, extends: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, dto_id, pos, name, java_name, type_json, nullable, owner): what each class sends, its own and inherited.

    ``classes`` also has ``ignored`` (names that it doesn't send, or null). ``members``: repo, dto_id, pos, kind, name, json_name, type_json,
    nullable, skipped; kind ``field``, or ``method`` for a method without parameters, which counts as a getter if its name
    says so (a boolean's by ``isX`` too). ``skipped`` marks what isn't sent: static, transient or ignored.

    Supertypes come first, in a class its fields, then its getters. A field replaces what has its Java name and keeps its
    place; a skipped field says nothing; a getter counts where its name is free, and a skipped one frees it. Names are
    those that a member states, else the Java name under the nearest strategy. Rows of ``members`` that repeat count once.
    """
    boolean = F.get_json_object("type_json", "$.name").isin("boolean", "Boolean")
    java = F.when(F.col("kind") == "field", F.col("name")).otherwise(getter_property(F.col("name"), boolean))
    own = members.distinct().withColumn("java_name", java).where("java_name IS NOT NULL AND NOT (skipped AND kind = 'field')")
    above = lineages(classes, extends).join(classes.select("repo", F.col("dto_id").alias("ancestor"), "type_parameters"), ["repo", "ancestor"])
    met = above.join(own.withColumnRenamed("dto_id", "ancestor"), ["repo", "ancestor"])
    at = F.struct("place", (F.col("kind") != "field").alias("late"), "pos", F.col("name").alias("member"))
    json_name = F.col("java_name")
    for s in STRATEGIES:
        json_name = F.when(F.col("naming") == s, rename(F.col("java_name"), s)).otherwise(json_name)
    value = F.struct(F.coalesce(F.when(F.col("json_name") != "", F.col("json_name")), json_name).alias("name"), substitute(F.col("type_json"), F.col("type_parameters"), F.col("env")).alias("type_json"), "nullable", F.col("ancestor").alias("owner"))
    rows = met.select("repo", "dto_id", "java_name", "kind", "skipped", at.alias("at"), value.alias("value"))
    freed = rows.where("skipped").groupBy("repo", "dto_id", "java_name").agg(F.max("at").alias("freed"))
    live = rows.where("NOT skipped").join(freed, ["repo", "dto_id", "java_name"], "left").where(F.col("freed").isNull() | (F.col("at") > F.col("freed")))
    field = F.when(F.col("kind") == "field", F.col("at"))
    kept = live.groupBy("repo", "dto_id", "java_name").agg(F.min("at").alias("at"), F.max_by("value", field).alias("field"), F.min_by("value", "at").alias("first"))
    named = kept.select("repo", "dto_id", "java_name", "at", F.coalesce("field", "first").alias("v")).select("repo", "dto_id", "java_name", "at", "v.*")
    ignored = classes.select("repo", "dto_id", F.explode("ignored").alias("name")).distinct()
    sent = named.join(ignored, ["repo", "dto_id", "name"], "left_anti")
    # a class's fields are few: they are numbered within one row
    listed = sent.groupBy("repo", "dto_id").agg(F.array_sort(F.collect_list(F.struct("at", "java_name", "name", "type_json", "nullable", "owner"))).alias("all"))
    return listed.select("repo", "dto_id", F.posexplode("all").alias("pos", "f")).select("repo", "dto_id", "pos", "f.name", "f.java_name", "f.type_json", "f.nullable", "f.owner")
