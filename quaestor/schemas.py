"""Explicit schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S = StringType()

SCRAPED_PAGE = StructType([StructField("url", _S), StructField("text", _S), StructField("links", ArrayType(_S))])
TEXT_FILE = StructType([StructField("file", _S), StructField("text", _S)])
PROCESSED_FILE = StructType([StructField("file", _S), StructField("text", _S), StructField("source_url", _S)])
FACT = StructType([StructField("source", _S), StructField("fact", _S)])
VECTOR_ROW = StructType([StructField("id", _S), StructField("document", _S), StructField("embedding", ArrayType(FloatType())), StructField("metadata", MapType(_S, _S))])
HIT = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()), StructField("text", _S), StructField("source_url", _S)])
REQUEST = StructType([StructField("query_id", LongType()), StructField("query", _S)])
RESPONSE = StructType([StructField("query_id", LongType()), StructField("answer", _S), StructField("sources", ArrayType(_S))])
TURN = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", _S), StructField("text", _S)])
