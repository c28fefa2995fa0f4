"""Struct types of Arrow functions, which are made where no session is."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegerType, StringType, StructType

TEXT, NUMBER, FLAG, BINARY = StringType(), IntegerType(), BooleanType(), BinaryType()
TEXTS = ArrayType(TEXT)


def struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out
