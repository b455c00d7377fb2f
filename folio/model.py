"""Canonical schemas, constants and errors."""

from __future__ import annotations

from pyspark.sql import types as T

SECTIONS = ("header", "body", "footer")
SECTION_STATS = ("tokenCount", "lineCount", "emptyLineCount", "capAlphaSeq", "sentenceCount")

TOKENS = T.StructType().add("htid", "string").add("page", "integer").add("section", "string").add("token", "string").add("pos", "string").add("count", "long")
LINE_CHARS = T.StructType().add("htid", "string").add("page", "integer").add("section", "string").add("place", "string").add("char", "string").add("count", "long")
SECTION_FEATURES = T.StructType().add("htid", "string").add("page", "integer").add("section", "string").add("tokenCount", "integer").add("lineCount", "integer").add("emptyLineCount", "integer").add("capAlphaSeq", "integer").add("sentenceCount", "integer")
PAGE_FEATURES = T.StructType().add("htid", "string").add("page", "integer").add("languages", "string").add("calculatedLanguage", "string").add("version", "string")


class MissingFieldError(KeyError):
    """A stored table lacks a dimension that a query asks for."""


class MissingDataError(FileNotFoundError):
    """A table or volume is not stored."""
