"""Record types for a whole registry (S12): the least type that holds the records of
every version of a schema, and results written once per type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.joins import lookup_join
from recordloom.operators.registry import schema_fields
from recordloom.session import materialise

ITEM = "~i"
ANY = 64
_BITS = {"boolean": 1, "integer": 2, "number": 4, "string": 8, "array": 16, "object": 32}
#: Kinds by the bits of all that was declared; any other mixture is a variant.
_KINDS = {
    1: "boolean",
    2: "bigint",
    4: "decimal(38,9)",
    6: "decimal(38,9)",
    8: "string",
    16: "array",
    32: "struct",
}


def _mask(types: str) -> Column:
    """What a field was declared as, in bits: null adds none, no declaration is any."""
    bits = sum(
        (F.when(F.array_contains(types, name), bit).otherwise(0) for name, bit in _BITS.items()),
        F.lit(0),
    )
    return F.when(F.col(types).isNull(), ANY).otherwise(bits)


def joined_fields(schemas: DataFrame) -> DataFrame:
    """One row per schema_name and path: the least kind above those of all versions.

    boolean, bigint, string, array and struct are above themselves, decimal(38,9) is
    above bigint, and variant is above all; a field that is only null or not declared
    is a variant. Kinds are joined as bits, on the map side first, so a schema with
    very many versions is a few rows at the shuffle.
    """
    fields = schema_fields(schemas).withColumn("_mask", _mask("types"))
    joined = fields.groupBy("schema_name", "path").agg(
        F.max("depth").alias("depth"), F.bit_or("_mask").alias("_mask")
    )
    kind = F.lit("variant")
    for mask, name in _KINDS.items():
        kind = F.when(F.col("_mask") == mask, name).otherwise(kind)
    return joined.select("schema_name", "path", "depth", kind.alias("kind"))


def _quoted(name: Column) -> Column:
    plain = F.replace(F.replace(name, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.concat(F.lit("`"), F.replace(plain, F.lit("`"), F.lit("``")), F.lit("`"))


def record_types(schemas: DataFrame) -> DataFrame:
    """schema_name and record_type, a type in DDL that the records of all its versions
    fit; built from the deepest fields upwards.

    An object that declares no member, one whose members differ only by the case of
    their letters, and items without a declaration are variants. A schema without any
    field has no row.
    """
    fields = materialise(joined_fields(schemas), "joined-fields")
    deepest = fields.agg(F.max("depth").alias("depth")).first().depth or 0
    inner = None
    for depth in range(deepest, 0, -1):
        here = fields.filter(F.col("depth") == depth).drop("depth")
        if inner is None:
            here = here.withColumns(
                {"_members": F.lit(None).cast("string"), "_item": F.lit(None).cast("string")}
            )
        else:
            here = here.join(inner, ["schema_name", "path"], "left")
        item = F.coalesce("_item", F.lit("variant"))
        ddl = (
            F.when(F.col("kind") == "struct", F.coalesce("_members", F.lit("variant")))
            .when(F.col("kind") == "array", F.concat(F.lit("array<"), item, F.lit(">")))
            .otherwise(F.col("kind"))
        )
        name = F.substring_index("path", "/", -1)
        member = F.when(name != ITEM, F.struct(name.alias("name"), ddl.alias("ddl")))
        within = here.select(
            "schema_name",
            F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("path"),
            member.alias("member"),
            F.when(name == ITEM, ddl).alias("item"),
        )
        parents = within.groupBy("schema_name", "path").agg(
            F.sort_array(F.collect_list("member")).alias("members"),
            F.count_distinct(F.lower("member.name")).alias("names"),
            F.max("item").alias("_item"),
        )
        parts = F.transform("members", lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["ddl"]))
        clear = (F.col("names") == F.size("members")) & (F.col("names") > 0)
        struct = F.concat(F.lit("struct<"), F.array_join(parts, ","), F.lit(">"))
        inner = parents.select("schema_name", "path", F.when(clear, struct).alias("_members"), "_item")
    if inner is None:
        return fields.select("schema_name", F.col("kind").alias("record_type"))
    whole = F.coalesce("_members", F.lit("variant"))
    return inner.filter("path = ''").select("schema_name", whole.alias("record_type"))


def write_typed(results: DataFrame, types: DataFrame, path: str, most: int = 1_000) -> list[str]:
    """Write the ``result`` of every row as a typed ``record``, one folder a type, and
    return the types in the order of their folders (``type=0`` and so on).

    Schemas of equal type share a folder. Rows are stored once by the number of their
    type, so that each type reads its own rows only. More than ``most`` types are
    refused before anything is written. Rows whose schema has no type are in no folder;
    a result that does not fit its type gives a record of nulls.
    """
    spark = results.sparkSession
    types = materialise(types, "record-types")
    distinct = types.select("record_type").distinct().orderBy("record_type").limit(most + 1)
    found = [row.record_type for row in distinct.collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} record types")
    numbers = spark.createDataFrame(list(enumerate(found)), "type int, record_type string")
    by_name = types.join(F.broadcast(numbers), "record_type").select("schema_name", "type")
    tagged = lookup_join(results, by_name, ["schema_name"], "inner", spread_by=("request_id",))
    stored = f"{path}/untyped"
    tagged.write.partitionBy("type").parquet(stored)
    for number, ddl in enumerate(found):
        rows = spark.read.schema(tagged.schema).parquet(stored).filter(F.col("type") == number)
        rows.withColumn("record", F.from_json("result", ddl)).drop("type").write.parquet(
            f"{path}/type={number}"
        )
    return found
