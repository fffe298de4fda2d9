"""Files to chunks: dispatch by extension, and the table-valued operator over a files table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import TokenCount, token_counter
from ..operators.split import split_oversized
from ..schema import CHUNK
from ..session import ship
from ..settings import Settings
from .documents import markdown_chunks, text_chunks
from .python import python_chunks
from .rows import Source, python_module, script_module
from .script import script_chunks

_LANGUAGES = {".py": "python", ".md": "markdown", ".txt": "text", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
_PARSERS = {"python": python_chunks, "markdown": markdown_chunks, "text": text_chunks, "javascript": script_chunks, "typescript": script_chunks}


#: Sources, and chunk rows, whose rows leave a worker together.
_BATCH_BYTES = 2 << 20
_BATCH_ROWS = 2_048


def parse_file(path: str, content: bytes, commit: str | None = None) -> list[dict]:
    """Chunk rows of one file; none for an extension that has no parser."""
    language = _LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None
    if language is None:
        return []
    module = python_module(path) if language == "python" else script_module(path) if language in ("javascript", "typescript") else ""
    src = Source(path, content.decode("utf-8", errors="ignore"), language, module, commit)
    _PARSERS[language](src)
    return src.rows


def parse_files(files: DataFrame, commit: str | None = None) -> DataFrame:
    """Chunk rows of files(file_path, content), one file at a time; `ord` follows (path, place in file)."""
    ship(files.sparkSession)
    schema = to_arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                content = content.as_py() or b""
                for k, r in enumerate(parse_file(path.as_py(), content, commit)):
                    r["ord"] = k
                    held.append(r)
                size += len(content)
                if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("file_path", "content").mapInArrow(run, CHUNK)


def create_chunks(files: DataFrame, settings: Settings | None = None, commit: str | None = None, count: TokenCount | None = None) -> DataFrame:
    """All chunks of the files, oversized ones in parts.  Order them by (file order, ord)."""
    s = settings or Settings()
    parsed = parse_files(files, commit)
    return split_oversized(parsed, s.max_chunk_tokens, s.chunk_overlap_tokens, count or token_counter(s.token_counter), s.splittable_chunk_types)


def in_file_order(chunks: DataFrame) -> DataFrame:
    """chunks with `ord` numbering all of them by path, part by part, and place.

    Numbers are unique and increasing, not dense: a range partition's number and the place in it, so
    no task ever sees all rows.
    """
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = F.split("file_path", "/")
    laid = chunks.repartitionByRange(parts, path, "ord").sortWithinPartitions(path, "ord")
    return laid.withColumn("ord", F.monotonically_increasing_id())
