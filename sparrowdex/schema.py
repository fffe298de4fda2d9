"""The row types of the engine and its fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of chunk types, as stored indexes use them.
CHUNK_TYPES = (
    "class",
    "enum",
    "file_metadata",
    "function",
    "imports",
    "markdown_section",
    "method",
    "parse_error",
    "text_file",
    "ts_interface",
    "type_alias",
)
# Which of them are searched and split, the files that are read, the folders that are not.
SEARCHABLE_TYPES = ("class", "function", "method", "markdown_section", "text_file", "ts_interface", "type_alias", "enum")
SPLITTABLE_TYPES = tuple(t for t in SEARCHABLE_TYPES if t != "class")
SUPPORTED_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".md", ".txt")
IGNORED_DIRS = (".git", ".venv", "venv", "node_modules", "dist", "build", "coverage", "target", "__pycache__")

# Names of the chunk columns, as stored metadata uses them.
_COLUMNS: list[tuple[str, T.DataType]] = [
    ("id", T.StringType()),
    ("content", T.StringType()),
    ("file_path", T.StringType()),
    ("module", T.StringType()),
    ("language", T.StringType()),
    ("commit", T.StringType()),
    ("chunk_type", T.StringType()),
    ("symbol", T.StringType()),
    ("qualified_symbol", T.StringType()),
    ("start_line", T.IntegerType()),
    ("end_line", T.IntegerType()),
    ("has_parse_errors", T.BooleanType()),
    ("parse_error_lines", T.ArrayType(T.IntegerType())),
    ("file_metadata_id", T.StringType()),
    ("imports", T.ArrayType(T.StringType())),
    ("signature", T.StringType()),
    ("docstring", T.StringType()),
    ("decorators", T.ArrayType(T.StringType())),
    ("is_async", T.BooleanType()),
    ("calls", T.ArrayType(T.StringType())),
    ("parent_symbol", T.StringType()),
    ("is_test", T.BooleanType()),
    ("is_static", T.BooleanType()),
    ("kind", T.StringType()),
    ("class_name", T.StringType()),
    ("heading", T.StringType()),
    ("heading_level", T.IntegerType()),
    ("parent_headings", T.ArrayType(T.StringType())),
    ("is_chunk_part", T.BooleanType()),
    ("part_index", T.IntegerType()),
    ("part_count", T.IntegerType()),
    ("parent_chunk_id", T.StringType()),
    ("ord", T.LongType()),
]

#: One row of the chunk table; `ord` is its place in insertion order.
CHUNK = T.StructType([T.StructField(n, t) for n, t in _COLUMNS])

#: Columns that a vector row carries for filtering, besides id and embedding.
VECTOR_METADATA = ("file_path", "module", "language", "commit", "chunk_type", "symbol", "qualified_symbol", "start_line", "end_line", "file_metadata_id", "has_parse_errors")
VECTOR = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, t) for n, t in _COLUMNS if n in VECTOR_METADATA or n == "ord"]
)
MANIFEST = T.StructType(
    [T.StructField("file_path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("chunk_ids", T.ArrayType(T.StringType()))]
)
FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("content", T.BinaryType())])
#: One row: the settings that an index depends on, as JSON.
CONFIG = T.StructType([T.StructField("config", T.StringType())])
