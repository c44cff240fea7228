"""Stored JSON against a nested schema, strictly: every fault by its path, and typed values where there is none.

What a schema says of a JSON value: decimals, dates and times are texts, true is
no number, a text is nothing else, objects hold no unknown keys. A field whose
metadata has optional may be absent; one with typed_by names the sibling that
says which kind of text it is (DECIMAL, DATE, others any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, MapType, StringType, StructType, TimestampType

from tallybook.functions.text import let

TEXTS = "array<string>"
#: A decimal as it is written back: no leading zeros, no exponent, no sign but a minus.
DECIMAL_TEXT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
WHOLE = ["BIGINT", "DECIMAL(38,0)"]


def _one(path: Column, code: str) -> Column:
    return F.array(F.concat(path, F.lit(f":{code}")))


def _none() -> Column:
    return F.array().cast(TEXTS)


def _text_fault(text: Column, path: Column, kind: DataType | Column) -> Column:
    """The fault of a text that stands for a decimal, a date or a time."""
    decimal = F.when(text.rlike(DECIMAL_TEXT), _none()).otherwise(_one(path, "DECIMAL_MALFORMED"))
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), _none()).otherwise(_one(path, "DATE_MALFORMED"))
    if isinstance(kind, Column):
        return F.when(kind == "DECIMAL", decimal).when(kind == "DATE", date).otherwise(_none())
    if isinstance(kind, DecimalType):
        return decimal
    return date if isinstance(kind, DateType) else F.when(text.try_cast("timestamp").isNotNull(), _none()).otherwise(_one(path, "TIME_MALFORMED"))


def _faults(value: Column, kind: DataType, nullable: bool, path: Column, typed_by: Column | None = None) -> Column:
    """Faults of a variant value: an array of path:CODE."""

    def test(v: Column) -> Column:
        said = F.schema_of_variant(v)
        if isinstance(kind, StructType):
            known = F.array(*[F.lit(f.name) for f in kind.fields])

            def members(m: Column) -> Column:
                unknown = F.transform(F.array_sort(F.array_except(F.map_keys(m), known)), lambda k: F.concat(path, F.lit("/"), k, F.lit(":UNKNOWN_KEY")))
                parts = [unknown]
                for f in kind.fields:
                    at = F.concat(path, F.lit(f"/{f.name}"))
                    sibling = F.try_variant_get(F.try_element_at(m, F.lit(f.metadata["typed_by"])), "$", "string") if "typed_by" in f.metadata else None
                    held = _faults(F.try_element_at(m, F.lit(f.name)), f.dataType, f.nullable, at, sibling)
                    absent = _none() if f.metadata.get("optional") else _one(at, "MISSING_KEY")
                    parts.append(F.when(F.map_contains_key(m, F.lit(f.name)), held).otherwise(absent))
                return F.flatten(F.array(*parts))

            found = F.when(said.startswith("OBJECT"), let(F.try_variant_get(v, "$", "map<string,variant>"), members)).otherwise(_one(path, "NOT_AN_OBJECT"))
        elif isinstance(kind, ArrayType):
            items = F.try_variant_get(v, "$", "array<variant>")
            each = F.flatten(F.transform(items, lambda x, i: _faults(x, kind.elementType, kind.containsNull, F.concat(path, F.lit("/"), i.cast("string")))))
            found = F.when(said.startswith("ARRAY"), each).otherwise(_one(path, "NOT_A_LIST"))
        elif isinstance(kind, (DecimalType, DateType, TimestampType)) or typed_by is not None:
            text = _text_fault(F.try_variant_get(v, "$", "string"), path, kind if typed_by is None else typed_by)
            found = F.when(said == "STRING", text).otherwise(_one(path, "NOT_A_TEXT"))
        elif isinstance(kind, StringType):
            found = F.when(said == "STRING", _none()).otherwise(_one(path, "NOT_A_TEXT"))
        elif isinstance(kind, BooleanType):
            found = F.when(said == "BOOLEAN", _none()).otherwise(_one(path, "NOT_A_BOOLEAN"))
        elif isinstance(kind, LongType):
            found = F.when(said.isin(WHOLE), _none()).otherwise(_one(path, "NOT_AN_INTEGER"))
        elif isinstance(kind, DoubleType):
            found = F.when(said.isin("BIGINT", "DOUBLE", "FLOAT") | said.startswith("DECIMAL"), _none()).otherwise(_one(path, "NOT_A_NUMBER"))
        else:
            raise TypeError(f"no strict form for {kind.simpleString() if not isinstance(kind, MapType) else 'maps'}")
        return F.when(said == "VOID", _none() if nullable else _one(path, "NULL_VALUE")).otherwise(found)

    return let(value, test)


def hydrated(rows: DataFrame, column: str, schema: StructType) -> DataFrame:
    """rows with faults (an array, empty for an exact payload) and value (typed, null where there are faults)."""
    # within brackets, so that text behind the value is seen as well
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))), "$", "array<variant>")
    faults = let(listed, lambda x: F.when(F.coalesce(F.size(x), F.lit(-1)) == 1, _faults(F.get(x, F.lit(0)), schema, False, F.lit(""))).otherwise(F.array(F.lit(":NOT_JSON"))))
    told = rows.withColumn("faults", F.explode(F.array(faults)))  # one array in one array: worked out once
    return told.withColumn("value", F.when(F.size("faults") == 0, F.from_json(F.col(column), schema)))
