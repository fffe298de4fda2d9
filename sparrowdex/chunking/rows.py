"""What all parsers share: the source with its lines, and the building of chunk rows."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field


def python_module(path: str) -> str:
    parts = re.sub(r"\.[^./]*$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def script_module(path: str) -> str:
    parts = re.sub(r"\.[^./]*$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "index" else parts)


#: Folders and name heads that mark tests.
TEST_FOLDER = "tests"
TEST_HEAD = "test_"
_TEST_PLACE = re.compile(f"(?:^|/){TEST_FOLDER}/|(?:^|/){TEST_HEAD}[^/]*$")


def is_test(path: str, symbol: str) -> bool:
    """Below a folder of tests, in a file of tests, or a test by its own name."""
    return bool(_TEST_PLACE.search(path)) or symbol.split(".")[-1].startswith(TEST_HEAD)


@dataclass
class Source:
    """A decoded file; bytes that are no UTF-8 are left out."""

    path: str
    text: str
    language: str
    module: str = ""
    commit: str | None = None
    lines: list[str] = field(init=False)
    rows: list[dict] = field(default_factory=list)
    common: dict = field(default_factory=dict)

    def __post_init__(self):
        self.lines = self.text.splitlines()

    def identity(self, kind: str, symbol: str, start: int, end: int) -> str:
        return hashlib.sha1("|".join(map(str, (self.commit, self.path, kind, symbol, start, end))).encode()).hexdigest()

    def add(self, chunk_type: str, symbol: str, start: int, end: int, content: str | None = None, **more) -> None:
        """A row for lines start to end (from 1, inclusive); their text unless content is given."""
        row = {
            "id": self.identity(chunk_type, symbol, start, end),
            "content": "\n".join(self.lines[start - 1 : end]) if content is None else content,
            "file_path": self.path,
            "module": self.module,
            "language": self.language,
            "commit": self.commit,
            "chunk_type": chunk_type,
            "symbol": symbol,
            "qualified_symbol": f"{self.module}.{symbol}" if self.module else symbol,
            "start_line": start,
            "end_line": end,
        }
        self.rows.append(row | self.common | more)

    def begin_code(self, imports: list[tuple[int, int, str]], errors: list[int]) -> None:
        """The rows that each code file opens with: its metadata, and its imports as one chunk."""
        head = self.identity("file_metadata", self.path, 1, 1)
        texts = [t for _, _, t in imports]
        content = [f"file: {self.path}", f"module: {self.module}"]
        if texts:
            content += ["imports:", *texts]
        if errors:
            content.append("parse_error_lines: " + ",".join(map(str, errors)))
        self.add("file_metadata", self.path, 1, 1, "\n".join(content), imports=texts, has_parse_errors=bool(errors), parse_error_lines=errors, file_metadata_id=head)
        # code chunks only tell that there are errors, not where
        self.common = {"has_parse_errors": bool(errors), "parse_error_lines": [], "file_metadata_id": head}
        if imports:
            self.add("imports", "imports", imports[0][0], imports[-1][1], "\n".join(texts))

    def add_errors(self, errors: list[int]) -> None:
        for line in errors:
            self.add("parse_error", f"parse_error:{line}", line, line)
