"""Payloads of any shape, as VARIANT: walked to any depth, searched for ids and links, and put together again without some fields.

A walk takes the members of all objects and arrays of one depth in a round; rounds end when nothing nested is left. A node
is a row with the path of keys and positions that leads to it, so that rules on fields are conditions on paths and no
schema is needed. What stays is put together from the deepest level up, each object or array from its own members alone.

Defined results: a null payload has one node, of kind null; a JSON null within is a node of kind null too; objects list
their keys in order, as VARIANT does; an empty object or array stays one; ids of payloads tell them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.retrieval import kept

#: id, path (keys and positions), kind (object, array, value, null) and the value as JSON of each node.
NODE = ("id", "path", "kind", "json")


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(value.isNull() | (shape == "VOID"), "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("value")


def walk(payloads: DataFrame) -> DataFrame:
    """NODE rows of all nodes of payloads (id, payload: variant), the whole payload among them, staged."""
    spark = payloads.sparkSession
    level = kept(payloads.select("id", F.array().cast("array<string>").alias("path"), F.col("payload").alias("value")).withColumn("kind", _kind(F.col("value"))), "payload")
    out = None
    while True:
        scalar = F.when(F.col("kind") == "null", "null").when(F.col("kind") == "value", F.to_json("value"))
        nodes = level.select("id", "path", "kind", scalar.alias("json"))
        out = nodes if out is None else out.unionByName(nodes)
        nested = level.filter("kind IN ('object', 'array')")
        if nested.isEmpty():
            return kept(out, "payload-nodes")
        inside = spark.sql("SELECT n.id, n.path, n.kind AS outer, m.pos, m.key, m.value FROM {nested} n, LATERAL variant_explode(n.value) m", nested=nested)
        step = F.when(F.col("outer") == "object", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("#"), F.lpad(F.col("pos").cast("string"), 10, "0")))
        level = kept(inside.select("id", F.concat("path", F.array(step)).alias("path"), "value").withColumn("kind", _kind(F.col("value"))), "payload")


def key_of(path: Column) -> Column:
    """The key of a node in its object; null in an array, and of the whole."""
    last = F.element_at(path, -1)
    return F.when(F.size(path) > 0, F.when(last.startswith("."), F.substring(last, 2, 1 << 30)))


def strings(nodes: DataFrame) -> DataFrame:
    """id, path, text of all values; strings as they are, others as JSON."""
    text = F.coalesce(F.when(F.col("json").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v")), F.col("json"))
    return nodes.filter("kind = 'value'").select("id", "path", text.alias("text"))


def linked_ids(nodes: DataFrame, id_keys: Sequence[str], list_keys: Sequence[str], links: Sequence[str]) -> DataFrame:
    """id, found: each id that a payload names: values under id_keys, items of lists under list_keys (both up to '::'), and the first group of a link pattern in any string."""
    texts = strings(nodes).withColumn("bare", F.trim("text")).filter("bare <> ''")
    depth = F.size("path")
    listed = (depth > 1) & F.element_at("path", -1).startswith("#") & key_of(F.slice("path", F.lit(1), F.greatest(depth - 1, F.lit(0)))).isin(*list_keys)
    direct = F.coalesce(key_of(F.col("path")).isin(*id_keys), F.lit(False)) | F.coalesce(listed, F.lit(False))
    first = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("bare", p, 1)), F.lit("")) for p in links]) if links else F.lit(None).cast("string")
    found = texts.select("id", F.array_compact(F.array(F.when(direct, F.nullif(F.substring_index("bare", "::", 1), F.lit(""))), first)).alias("all"))
    return found.select("id", F.explode("all").alias("found")).distinct()


def _under(path: Column, rule: Sequence[str]) -> Column:
    """Whether a path is, or leads through, the field that a rule names by keys: '**' first for any depth."""
    keys = F.transform(path, lambda p: F.when(p.startswith("."), F.substring(p, 2, 1 << 30)))
    if rule[0] == "**":
        rest = list(rule[1:])
        starts = F.filter(F.sequence(F.lit(0), F.size(path)), lambda i: i + len(rest) <= F.size(path))
        return F.exists(starts, lambda i: F.coalesce(F.slice(keys, i + 1, F.lit(len(rest))) == F.array(*[F.lit(k) for k in rest]), F.lit(False)))
    return F.coalesce(F.slice(keys, 1, len(rule)) == F.array(*[F.lit(k) for k in rule]), F.lit(False))


def without_fields(nodes: DataFrame, rules: Sequence[Sequence[str]]) -> DataFrame:
    """nodes without the fields that rules name, and all below them. A rule is a field's keys from the top, or '**' and its last keys at any depth."""
    gone = F.lit(False)
    for rule in rules:
        gone = gone | _under(F.col("path"), rule)
    return nodes.filter(~gone)


def only_fields(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """nodes whose field at the top is one of names."""
    return nodes.filter((F.size("path") == 0) | F.substring(F.get("path", F.lit(0)), 2, 1 << 30).isin(*names))


def with_values(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """nodes with other values (id, path, json) at some paths; what stood below these goes. A path that isn't there is added if its object is."""
    given = kept(values.select(F.col("id").alias("of"), F.col("path").alias("at"), F.col("json").alias("new")), "payload-values")
    under = nodes.join(given, (F.col("id") == F.col("of")) & (F.slice("path", F.lit(1), F.size("at")) == F.col("at")), "left_anti")
    there = given.join(nodes.filter("kind = 'object'").select(F.col("id").alias("n"), F.col("path").alias("p")), (F.col("of") == F.col("n")) & (F.slice("at", F.lit(1), F.size("at") - 1) == F.col("p")), "left_semi")
    return under.unionByName(there.select(F.col("of").alias("id"), F.col("at").alias("path"), F.when(F.col("new") == "null", "null").otherwise("value").alias("kind"), F.col("new").alias("json")))


def nested(nodes: DataFrame) -> DataFrame:
    """id, json: the payloads that nodes make, keys in order."""
    nodes = kept(nodes, "payload-kept")
    deepest = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    made = None
    for depth in range(deepest, -1, -1):
        own = nodes.filter(F.size("path") == depth)
        leaf = own.filter("kind NOT IN ('object', 'array')").select("id", "path", "json")
        if made is not None:
            inside = made.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("step"), "json").alias("member"))
            members = inside.groupBy(F.col("id").alias("of"), F.col("path").alias("at")).agg(F.array_sort(F.collect_list("member")).alias("members"))
            outer = own.filter("kind IN ('object', 'array')").join(members, F.col("id").eqNullSafe(F.col("of")) & (F.col("path") == F.col("at")), "left")
        else:
            outer = own.filter("kind IN ('object', 'array')").withColumn("members", F.lit(None).cast("array<struct<step: string, json: string>>"))
        quoted = lambda m: F.concat(F.regexp_replace(F.to_json(F.array(F.substring(m["step"], 2, 1 << 30))), r"^\[|\]$", ""), F.lit(":"), m["json"])
        fields, items = F.array_join(F.transform("members", quoted), ","), F.array_join(F.transform("members", lambda m: m["json"]), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce(fields, F.lit("")), F.lit("}"))).otherwise(F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]")))
        made = kept(leaf.unionByName(outer.select("id", "path", text.alias("json"))), "payload-made")
    return made.select("id", "json")
