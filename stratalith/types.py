"""The four scalar types, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    INT64 = "Int64"
    FLOAT64 = "Float64"
    BOOL = "Bool"
    STRING = "String"

    def __str__(self) -> str:
        return self.value

    @property
    def spark(self) -> T.DataType:
        return {"Int64": T.LongType(), "Float64": T.DoubleType(), "Bool": T.BooleanType(), "String": T.StringType()}[self.value]

    @property
    def default(self):
        return {"Int64": 0, "Float64": 0.0, "Bool": False, "String": ""}[self.value]

    @classmethod
    def parse(cls, name: str) -> DataType | None:
        return {"INT64": cls.INT64, "FLOAT64": cls.FLOAT64, "BOOL": cls.BOOL, "BOOLEAN": cls.BOOL, "STRING": cls.STRING}.get(name.upper())

    @classmethod
    def of_spark(cls, kind: T.DataType) -> DataType | None:
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return cls.INT64
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return cls.FLOAT64
        return {T.BooleanType: cls.BOOL, T.StringType: cls.STRING}.get(type(kind))

    @classmethod
    def of_value(cls, value) -> DataType:
        return {bool: cls.BOOL, int: cls.INT64, float: cls.FLOAT64, str: cls.STRING}[type(value)]


@dataclass(frozen=True)
class Field:
    """A column. Only Int64 columns of engine tables are nullable; frames read from files may have nulls anywhere."""

    name: str
    type: DataType
    nullable: bool = False

    @property
    def declared(self) -> str:
        return f"Nullable({self.type})" if self.nullable and self.type is DataType.INT64 else str(self.type)
