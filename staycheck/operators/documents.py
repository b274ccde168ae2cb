"""JSON documents compared path by path, and files compared by digest."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck.functions.text import let
from staycheck.session import stage


FIELD_LIMIT = 6
VALUE_LIMIT = 48


# levels opened between two writes of a comparison
LEVELS_A_PASS = 4
LEVEL = ["_k", "path", "a", "b", "why"]


def _kind(json: Column) -> Column:
    """object, array, number, string, boolean or null, by the first character of a text that can be read."""
    first = F.substring(F.ltrim(json, F.lit(" \t\r\n")), 1, 1)
    return (F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string")
            .when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number"))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Columns worked out once a row. A plain column is worked out again wherever the next steps use it, as Spark
    writes steps into one another; what explode gives is a value."""
    held = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()])))
    return df.select("*", held.alias("_held")).select("*", "_held.*").drop("_held")


def _judged(level: DataFrame, whole: bool = False) -> DataFrame:
    """Pairs with what they differ in (why; null: to be opened) and their values (_va, _vb, _ka: a's kind); equal ones
    are left out, and what is told already stays as it is. Equal objects and lists are left out here only where whole is
    set: opened, they give no members."""
    a, b = F.col("a"), F.col("b")
    kinds, texts = (F.col("_ka"), F.col("_kb")), (F.to_json("_va"), F.to_json("_vb"))
    same = kinds[0] == kinds[1]
    held = kinds[0].isin("object", "array"), kinds[1].isin("object", "array")
    compared = same if whole else same & ~held[0]
    equal = compared & (texts[0] == texts[1]) | same & (kinds[0] == "number") & (
        a.try_cast("decimal(38,18)") == b.try_cast("decimal(38,18)"))
    found = (
        F.when(F.col("why").isNotNull(), F.col("why"))
        .when(a.isNull() | b.isNull(), "one side only")
        .when(equal, "equal")
        .when(F.col("_va").isNull() | F.col("_vb").isNull(), "unreadable")
        .when((held[0] | held[1]) & ~same, "other kind")
        .when((kinds[0] == "array") & (F.json_array_length(a) != F.json_array_length(b)), "length")
        .when(~held[0], "value"))
    parsed = _once(level, _va=F.try_parse_json(a), _vb=F.try_parse_json(b), _ka=_kind(a), _kb=_kind(b))
    return _once(parsed, _found=found).filter("_found is null or _found <> 'equal'").drop("why").withColumnRenamed(
        "_found", "why")


def _opened(judged: DataFrame, volatile: list[str]) -> DataFrame:
    """Pairs to be opened become the members that differ; the others stay. Both versions of an object or array
    are in one row, so their members meet there by name and equal ones move nowhere."""
    def members(value: Column) -> Column:
        """The JSON text of each member by its name."""
        items = value.cast("array<variant>")
        return F.when(F.col("_ka") == "array", F.map_from_arrays(
            F.transform(items, lambda _, i: F.format_string("[%d]", i)), F.transform(items, lambda x: F.to_json(x)))).otherwise(
            F.transform_values(value.cast("map<string,variant>"), lambda _, x: F.to_json(x)))

    met = F.map_zip_with(members(F.col("_va")), members(F.col("_vb")), lambda _, x, y: F.when(
        ~x.eqNullSafe(y), F.struct(x.alias("a"), y.alias("b"))))
    differing = F.filter(F.map_entries(met), lambda e: e["value"].isNotNull())
    stem = F.concat("path", F.when((F.col("path") == "") | (F.col("_ka") == "array"), "").otherwise("."))
    none = F.lit(None).cast("string")
    told = F.array(F.struct("path", none.alias("a"), none.alias("b"), "why"))
    inner = F.transform(differing, lambda e: F.struct(
        F.concat(stem, e["key"]).alias("path"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b"), none.alias("why")))
    # outer: before a plain explode Spark would work the members out twice more, to leave out rows that have none
    rows = judged.select("_k", F.explode_outer(F.when(F.col("why").isNotNull(), told).otherwise(inner)).alias("m"))
    return rows.select("_k", "m.*").filter("path is not null").filter(F.col("why").isNotNull() | _kept(volatile))


def _kept(volatile: list[str]) -> Column:
    plain = F.regexp_replace("path", r"\[[0-9]+\]", "")
    kept = F.lit(True)
    for name in volatile:
        kept = kept & (plain != name) & ~plain.startswith(name + ".")
    return kept


def _met(pairs: DataFrame, volatile: list[str]) -> DataFrame:
    """Members of the pairs of keys that come more than once: as for the documents, each version's member meets
    each other version's of its path."""
    def members(side: str) -> DataFrame:
        value = pairs.select("_k", "path", _kind(F.col("a")).alias("kind"), F.parse_json(side).alias("v"))
        inner = value.lateralJoin(pairs.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("kind") == "array", F.format_string("[%d]", "pos")).otherwise(
            F.concat(F.when(F.col("path") == "", "").otherwise("."), "key"))
        return inner.select("_k", F.concat("path", name).alias("path"), F.to_json("value").alias(side))

    left, right = members("a"), members("b").withColumnsRenamed({"_k": "_o", "path": "_p"})
    met = left.join(right, F.col("_k").eqNullSafe(F.col("_o")) & (F.col("path") == F.col("_p")), "full_outer").select(
        F.coalesce("_k", "_o").alias("_k"), F.coalesce("path", "_p").alias("path"), "a", "b", F.lit(None).cast("string").alias("why"))
    return met.filter(_kept(volatile) & ~F.col("a").eqNullSafe(F.col("b")))


def diff_documents(a: DataFrame, b: DataFrame, key: str, column: str,
                   volatile: list[str]) -> DataFrame:
    """Paths at which two versions of each document differ, volatile fields apart.

    A key on one side only, or a list of another length, is reported once, not for every leaf
    under it, and so is a document of one side only (path ''). A document that is no JSON, or repeats a key,
    is reported as unreadable where its two texts differ; the others go on.

    Versions meet by key once, and equal texts drop out. From there on a row holds both versions of a part: its
    members meet by name inside the row, equal ones drop out, and only differing objects and lists of one length
    are opened, some levels between two writes. So work grows with what differs and nothing else is sent. Where
    a key comes more than once, every version meets every other one, at each level anew; these few keys' members
    meet by a join.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"_{name}"), F.col(column).alias(name), F.lit(True).alias(f"in_{name}"))

    both = side(a, "a").join(side(b, "b"), F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    both = both.filter(~F.col("a").eqNullSafe(F.col("b")) | F.col("in_a").isNull() | F.col("in_b").isNull())
    # a null text is a document too, and no JSON
    texts = [F.when(F.col(f"in_{x}"), F.coalesce(x, F.lit(""))).alias(x) for x in ("a", "b")]
    level = both.select(F.coalesce("_a", "_b").alias("_k"), F.lit("").alias("path"), *texts, F.lit(None).cast("string").alias("why"))
    alone, told = stage(level), []
    repeated = stage(alone.groupBy("_k").count().filter("count > 1").select(F.col("_k").alias("_r")))
    if not repeated.isEmpty():
        again = F.col("_k").eqNullSafe(F.col("_r"))
        inside, alone = alone.join(repeated, again, "left_semi"), alone.join(repeated, again, "left_anti")
        while True:
            told.append(stage(_judged(inside, whole=True).select(*LEVEL)))
            inside = told[-1].filter("why is null")
            if inside.isEmpty():
                break
            inside = _met(inside, volatile)
    while not told or not alone.isEmpty():
        for _ in range(LEVELS_A_PASS):
            alone = _opened(_judged(alone), volatile)
        told.append(stage(alone))
        alone = told[-1].filter("why is null")
    return functools.reduce(DataFrame.unionByName, [t.filter("why is not null").select(
        F.col("_k").alias(key), "path", "why") for t in told])


def digest_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = a.select(*keys, F.col("digest").alias("first"))
    right = b.select(*keys, F.col("digest").alias("second"))
    return left.join(right, keys, "full_outer").filter(
        ~F.col("first").eqNullSafe(F.col("second")))


def shape(json: Column, field_limit: int = FIELD_LIMIT, value_limit: int = VALUE_LIMIT) -> Column:
    """One line for a JSON text: short scalars shown, lists and objects counted, text longer than
    value_limit as a length, fields after field_limit counted. Of a repeated key the last value counts."""

    def said(kind: Column, text: Column) -> Column:
        """text: a string's characters, the JSON text of anything else."""
        return (
            F.when(kind.startswith("ARRAY<"), F.format_string("[%d]", F.json_array_length(text)))
            .when(kind.startswith("OBJECT<"), F.format_string("{%d}", F.size(F.json_object_keys(text))))
            .when(kind == "VOID", "-")
            .when(kind == "BOOLEAN", F.when(text == "true", "yes").otherwise("no"))
            .when((kind == "STRING") & (F.length(text) <= value_limit), F.concat(F.lit('"'), text, F.lit('"')))
            .when(kind == "STRING", F.format_string("…(%d chars)", F.length(text)))
            .otherwise(text))

    def entries(kind: str) -> Column:
        found = F.map_entries(F.from_json(json, f"map<string,{kind}>"))
        return let(found, lambda es: F.filter(es, lambda e, i: ~F.exists(
            F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])))

    typed, plain = entries("variant"), entries("string")
    fields = F.zip_with(F.slice(typed, 1, field_limit), F.slice(plain, 1, field_limit), lambda t, p: F.concat(
        t["key"], F.lit(" "), F.when(t["value"].isNull(), "-").otherwise(
            said(F.schema_of_variant(t["value"]), p["value"]))))
    more = F.size(typed) - field_limit
    single = F.try_parse_json(json)
    kind = F.schema_of_variant(single)
    return (
        F.when(json.isNull(), "nothing")
        .when(F.size(typed) == 0, "an empty object")
        .when(more > 0, F.concat(F.array_join(fields, " · "), F.format_string(" · +%d more field(s)", more)))
        .when(typed.isNotNull(), F.array_join(fields, " · "))
        .when(F.json_array_length(json).isNotNull(), F.format_string("[%d]", F.json_array_length(json)))
        .when(single.isNotNull(), said(kind, F.when(
            kind == "STRING", F.try_variant_get(single, "$", "string")).otherwise(F.trim(json))))
        .otherwise(F.format_string("unreadable JSON (%d chars)", F.length(json))))
