"""Types that UDFs return. They are built from classes, for DDL can be parsed only within a
session and modules are imported before there is one."""

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

STRINGS = ArrayType(StringType())
FLOATS = ArrayType(FloatType())
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
AGENT = StructType(
    [StructField("name", StringType()), StructField("birth_year", IntegerType()), StructField("death_year", IntegerType()), StructField("role", StringType()), StructField("source", StringType())]
)
