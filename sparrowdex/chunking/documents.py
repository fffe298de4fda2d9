"""Plain text and Markdown."""

from __future__ import annotations

import re

from .rows import Source

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")


def text_chunks(src: Source) -> None:
    """The whole text as one chunk, unless it is blank."""
    text = src.text.replace("\r\n", "\n").replace("\r", "\n")
    if text.strip():
        src.add("text_file", src.path, 1, max(1, len(text.splitlines())), text, qualified_symbol=None)


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line from 1, level, title) of # headings outside of fenced blocks."""
    found, fence = [], None
    for n, line in enumerate(lines, 1):
        line = line.lstrip("﻿\x00") if n == 1 else line
        if m := _FENCE.match(line):
            if fence is None and not (m[1][0] == "`" and "`" in m[2]):
                fence = m[1]
                continue
            if fence and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
                continue
        if fence is None and (m := _HEADING.match(line)):
            found.append((n, len(m[1]), (m[2] or "").strip() or "Section"))
    return found


def markdown_chunks(src: Source) -> None:
    """A chunk for each heading, up to the next of any level; what stands before the first is left out."""
    src.common = {"has_parse_errors": False, "parse_error_lines": []}
    marks = headings(src.lines)
    if not marks:
        if src.text.strip():
            src.add("markdown_section", "Document", 1, len(src.lines))
        return
    above: list[tuple[int, str]] = []
    for k, (line, level, title) in enumerate(marks):
        end = marks[k + 1][0] - 1 if k + 1 < len(marks) else len(src.lines)
        above = [a for a in above if a[0] < level]
        src.add("markdown_section", title, line, end, heading=title, heading_level=level, parent_headings=[t for _, t in above])
        above.append((level, title))
