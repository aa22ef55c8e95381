"""Schema algebra over Spark's StructType, which serialises to the log's schema strings unchanged."""
from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: unsigned Arrow integers widen to the next type that holds them all
_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def parse(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def same(a: T.StructType, b: T.StructType) -> bool:
    """Equality whatever the order of the columns."""
    key = lambda s: sorted(json.dumps(f.jsonValue(), sort_keys=True) for f in s)
    return key(a) == key(b)


def merge(*schemas: T.StructType) -> T.StructType:
    """All fields, first seen first; one name with two types raises."""
    fields: dict[str, T.StructField] = {}
    for s in schemas:
        for f in s:
            old = fields.get(f.name)
            if old is None:
                fields[f.name] = f
            elif old.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {old.dataType.simpleString()} and {f.dataType.simpleString()}")
            elif f.nullable and not old.nullable:
                fields[f.name] = f
    return T.StructType(list(fields.values()))


def common(*schemas: T.StructType) -> T.StructType:
    """The fields that all schemas have with one type and nullability, first seen first."""
    rest = [{(f.name, f.dataType.json(), f.nullable) for f in s} for s in schemas[1:]]
    return T.StructType([f for f in schemas[0] if all((f.name, f.dataType.json(), f.nullable) in r for r in rest)])


def arrow_to_spark(table: pa.Table) -> tuple[pa.Table, T.StructType]:
    """An Arrow table that Spark takes, and its schema; naive timestamps stay naive."""
    for i, f in enumerate(table.schema):
        kind = _WIDER.get(f.type, f.type.value_type if pa.types.is_dictionary(f.type) else None)
        if kind is not None:
            table = table.set_column(i, f.name, table.column(i).cast(kind))
    return table, from_arrow_schema(table.schema.remove_metadata(), prefer_timestamp_ntz=True)
