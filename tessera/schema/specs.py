"""Table declarations and what follows from them: StructTypes, DDL, differences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType())}


@dataclass(frozen=True)
class Field:
    """references: the table whose id this column holds."""

    name: str
    kind: str = "string"
    nullable: bool = True
    default: object = None
    references: str | None = None

    def struct(self) -> T.StructField:
        meta = {k: v for k, v in (("default", self.default), ("references", self.references)) if v is not None}
        return T.StructField(self.name, _TYPES[self.kind], self.nullable, meta)


@dataclass(frozen=True)
class Table:
    """key: columns by which a row is known; the first row of a key stays, or, of an entity, later values fill in."""

    name: str
    schema_type: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    date: str | None = None
    entity: bool = False
    embeddable: bool = False
    communication: bool = False
    unique: tuple[str, ...] = field(default=())

    def struct(self) -> T.StructType:
        return T.StructType([f.struct() for f in self.fields])

    def ddl(self, partition: str | None = None) -> str:
        columns = ",\n  ".join(f"{f.name} {_TYPES[f.kind].simpleString()}" + ("" if f.nullable else " NOT NULL") for f in self.fields)
        return f"CREATE TABLE IF NOT EXISTS {self.name} (\n  {columns}\n) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else "")


def differences(table: Table, found: T.StructType) -> list[tuple[str, str, str]]:
    """(column, problem, detail): what is missing, of another type, or not declared."""
    have = {f.name: f for f in found}
    out = [(f.name, "missing", _TYPES[f.kind].simpleString()) for f in table.fields if f.name not in have]
    out += [(f.name, "type", f"{have[f.name].dataType.simpleString()} is not {_TYPES[f.kind].simpleString()}") for f in table.fields if f.name in have and have[f.name].dataType != _TYPES[f.kind]]
    return out + [(n, "undeclared", have[n].dataType.simpleString()) for n in have if n not in {f.name for f in table.fields}]


def conformed(table: Table, rows: DataFrame) -> DataFrame:
    """rows with the declared columns in order: those that rows lack get their defaults, others are cast; undeclared ones go."""
    cols = [(F.coalesce(F.col(f.name), F.lit(f.default)) if f.default is not None else F.col(f.name)) if f.name in rows.columns else F.lit(f.default) for f in table.fields]
    return rows.select(*[c.cast(_TYPES[f.kind]).alias(f.name) for c, f in zip(cols, table.fields, strict=True)])


def orphans(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose column names no parent; a null names none and is fine."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col("id").alias(column)), column, "left_anti")


def missing_required(table: Table, rows: DataFrame) -> DataFrame:
    """(column, n): nulls in columns that mustn't have any."""
    wanted = [f.name for f in table.fields if not f.nullable]
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in wanted])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in wanted])).alias("x")).select("x.*").where("n > 0")
