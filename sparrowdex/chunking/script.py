"""JavaScript and TypeScript sources, by a scanner of brackets, strings and comments.

The scanner blanks out what is no code (comments, strings, templates, regular expressions, text
between tags) and then finds declarations at the top level and members at the top of class bodies.
It knows no grammar: brackets without a partner, and comments and templates without an end, are the
errors that it reports, each with its line, at any depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .rows import Source

_OPEN, _CLOSE = "([{", ")]}"
_NAME = r"[A-Za-z_$\w][\w$]*"
_START = re.compile(
    rf"(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:"
    rf"(?P<class>class)\s+(?P<cname>{_NAME})|(?P<func>(?:async\s+)?function)\s+(?P<fname>{_NAME})|(?P<iface>interface)\s+(?P<iname>{_NAME})"
    rf"|(?P<alias>type)\s+(?P<tname>{_NAME})\s*(?:<[^=]*>)?\s*=|(?P<enum>(?:const\s+)?enum)\s+(?P<ename>{_NAME})|(?P<var>const|let|var)\s+(?={_NAME}))"
)
_IMPORT = re.compile(r"import\b(?!\s*\()|export\s+(?:type\s+)?(?:\*|\{[^}]*\})[^;\n]*?\bfrom\b")
_MEMBER = re.compile(
    rf"(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|declare|async|get|set)\s+(?![(=:;?]))*)\*?\s*(?P<name>#?{_NAME}|\[[^\]]*\])\s*(?P<opt>[?!])?"
)
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "super", "import", "constructor", "async", "with"}
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[\n+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new))\s*$")


@dataclass
class Scan:
    code: str  # the text with all that is no code blanked out, line ends kept
    match: dict[int, int]  # closing place of each opening bracket
    errors: list[int]  # places of brackets without partner


def scan(text: str) -> Scan:
    out, stack, match, errors = list(text), [], {}, []
    i, n = 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            if j < 0:
                errors.append(i)
            j = n if j < 0 else j + 2
            blank(i, j)
        elif c in "'\"":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            j = min(j + 1, n)
            blank(i + 1, j - 1)
        elif c == "`" or (c == "}" and stack and text[stack[-1]] == "`"):
            # a template: its text is blanked, what stands in ${} is code
            if c == "}":
                stack.pop()
            j = i + 1
            while j < n and text[j] != "`" and not text.startswith("${", j):
                j += 2 if text[j] == "\\" else 1
            blank(i + 1, j)
            if text.startswith("${", j):
                stack.append(text.rfind("`", 0, j) if c == "`" else i)
                out[j] = out[j + 1] = " "
                # the stack keeps a place whose character is ` so that the } above is known
                stack[-1] = text.rfind("`", 0, j)
                j += 2
            else:
                if j >= n:
                    errors.append(i)
                j = min(j + 1, n)
        elif c == "/" and _BEFORE_REGEX.search("".join(out[max(0, i - 24) : i])):
            j, inside = i + 1, False
            while j < n and text[j] != "\n" and (inside or text[j] != "/"):
                inside = text[j] == "[" or (inside and text[j] != "]")
                j += 2 if text[j] == "\\" else 1
            j = min(j + 1, n)
            blank(i, j)
        else:
            j = i + 1
            if c in _OPEN:
                stack.append(i)
            elif c in _CLOSE:
                if stack and text[stack[-1]] in _OPEN and _OPEN.index(text[stack[-1]]) == _CLOSE.index(c):
                    match[stack.pop()] = i
                else:
                    errors.append(i)
                    # an opening bracket was never closed: go back to one that fits
                    fit = next((k for k in range(len(stack) - 1, -1, -1) if text[stack[k]] in _OPEN and _OPEN.index(text[stack[k]]) == _CLOSE.index(c)), None)
                    if fit is not None:
                        errors[-1] = stack[fit + 1]
                        match[stack[fit]] = i
                        del stack[fit:]
        i = j
    errors += [k for k in stack if text[k] in _OPEN]
    return Scan("".join(out), match, sorted(errors))


class _Script:
    def __init__(self, src: Source):
        self.src, self.text = src, src.text
        self.scan = scan(self.text)
        self.code = self.scan.code
        self.line_of = [0]
        for m in re.finditer("\n", self.text):
            self.line_of.append(m.end())

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.line_of, at)

    def next_code(self, at: int, end: int | None = None) -> int:
        m = re.compile(r"\S").search(self.code, at, len(self.code) if end is None else end)
        return m.start() if m else (len(self.code) if end is None else end)

    def body(self, at: int, end: int) -> int:
        """The { that opens a body from `at` on, brackets before it skipped; end if there is none."""
        while at < end:
            c = self.code[at]
            if c == "{":
                return at
            if c in "([" and at in self.scan.match:
                at = self.scan.match[at]
            elif c == ";":
                return end
            at += 1
        return end

    def statement_end(self, at: int, end: int) -> int:
        """End of a statement that has no body: its ; or a line end where nothing goes on."""
        while at < end:
            c = self.code[at]
            if c in _OPEN and at in self.scan.match:
                at = self.scan.match[at]
            elif c == ";":
                return at + 1
            elif c == "}":
                return at
            elif c == "\n":
                before = self.code[:at].rstrip()[-1:]
                after = self.code[self.next_code(at, end) : end][:2]
                if before not in tuple("=|&,+-*?:(.<>") and after[:1] not in tuple("|&.?:+*=,") or after == "":
                    return at
            at += 1
        return end

    def doc(self, at: int) -> str:
        """The comment right above a place."""
        lines = self.text[: self.line_of[self.line(at) - 1]].splitlines()
        while lines and not lines[-1].strip():
            lines.pop()
        out: list[str] = []
        while lines and lines[-1].strip().startswith("//"):
            out.insert(0, lines.pop().strip()[2:].strip())
        if lines and lines[-1].strip().endswith("*/"):
            block = [lines.pop()]
            while lines and "/*" not in block[0]:
                block.insert(0, lines.pop())
            if "/*" in block[0]:
                inner = re.sub(r"^/\*+|\*+/$", "", "\n".join(block).strip())
                cleaned = [x.strip().lstrip("*").strip() for x in inner.splitlines()]
                out.insert(0, "\n".join(cleaned).strip())
        return "\n".join(out)

    def calls(self, a: int, b: int) -> list[str]:
        found = set()
        for m in re.finditer(rf"(?P<new>\bnew\s+)?(?P<f>(?:this|super|{_NAME})(?:\s*\??\.\s*#?{_NAME})*)\s*(?:<[\w\s,.\[\]|]*>)?\(", self.code[a:b]):
            name = self.text[a + m.start("f") : a + m.end("f")].strip()
            head = self.code[:a + m.start()].rstrip()
            if name in _NO_CALL or head.endswith("function"):
                continue
            close = self.scan.match.get(a + m.end() - 1)
            # a name, its parameters and a body: a method, not a call
            if close is not None and self.code[close + 1 :].lstrip()[:1] == "{" and "." not in name and not m["new"]:
                continue
            found.add(f"new {name}" if m["new"] else name)
        return sorted(found)

    def test(self, symbol: str) -> bool:
        p, last = self.src.path, symbol.rsplit(".", 1)[-1]
        return ".test." in p or ".spec." in p or "/__tests__/" in p or p.startswith("tests/") or last.startswith("test") or last in ("it", "describe")

    def signature(self, a: int, body: int) -> str:
        lines = self.text[a:body].splitlines()
        return lines[0].strip() if lines else ""

    def add(self, kind: str, symbol: str, a: int, b: int, body: int, doc_at: int, is_async: bool, is_static: bool = False, member: str = "", owner: str = "") -> None:
        last = max(a, b - 1)
        more = {"class_name": owner} if owner else {}
        self.src.add(
            kind, symbol, self.line(a), self.line(last), signature=self.signature(a, body), docstring=self.doc(doc_at), decorators=[], is_async=is_async,
            is_static=is_static, kind=member, calls=self.calls(body if body < b else a, b), parent_symbol=owner, is_test=self.test(symbol), **more,
        )

    def add_class(self, name: str, a: int, body: int, end: int, doc_at: int) -> None:
        members, fields, at = [], [], self.next_code(body + 1, end - 1)
        while at < end - 1:
            if self.code[at] == ";":
                at = self.next_code(at + 1, end - 1)
                continue
            if self.code[at] == "@":  # a decorator of a member
                m = re.compile(rf"@{_NAME}(?:\.{_NAME})*").match(self.code, at)
                at = m.end() if m else at + 1
                if at < end and self.code[at] == "(":
                    at = self.scan.match.get(at, at) + 1
                at = self.next_code(at, end - 1)
                continue
            m = _MEMBER.match(self.code, at)
            after = self.next_code(m.end(), end - 1) if m else at
            if m and self.code[after : after + 1] == "<":
                after = self.next_code(self.code.find(">", after) + 1, end - 1)
            if m and self.code[after : after + 1] == "(" and after in self.scan.match:
                open_at = self.body(after, end - 1)
                if open_at < end - 1 and open_at in self.scan.match:
                    stop = self.scan.match[open_at] + 1
                    members.append((m, at, stop, open_at))
                else:
                    stop = self.statement_end(after, end - 1)
                at = self.next_code(stop, end - 1)
                continue
            stop = max(self.statement_end(at, end - 1), at + 1)
            if m:
                fields.append(self.text[at:stop].strip().rstrip(";").strip())
            at = self.next_code(stop, end - 1)
        signature = self.signature(a, body)
        content = "\n".join([signature, *fields])
        first = self.line(a)
        self.src.add("class", name, first, first + len(fields), content, signature=signature, docstring=self.doc(doc_at), decorators=[], is_async=False, calls=[], parent_symbol="")
        for m, b, stop, open_at in members:
            mods = m["mods"].split()
            self.add("method", f"{name}.{m['name']}", b, stop, open_at, b, "async" in mods, "static" in mods, next((k for k in ("get", "set") if k in mods), "method"), name)

    def bindings(self, at: int, end: int, doc_at: int) -> None:
        """Functions among the variables of one declaration."""
        while at < end:
            m = re.compile(rf"(?P<n>{_NAME})").match(self.code, at)
            if not m:
                return
            stop, depth_at = end, m.end()
            while depth_at < end:
                c = self.code[depth_at]
                if c in _OPEN and depth_at in self.scan.match:
                    depth_at = self.scan.match[depth_at]
                elif c == ",":
                    stop = depth_at
                    break
                depth_at += 1
            value = re.compile(r"=(?!=|>)\s*").search(self.code, m.end(), stop)
            if value:
                v = value.end()
                is_async = self.code.startswith("async", v)
                w = self.next_code(v + 5, stop) if is_async else v
                arrow = re.compile(rf"(?:{_NAME})\s*=>").match(self.code, w)
                if self.code.startswith("function", w):
                    arrow = True
                elif w < stop and self.code[w] in "(<":
                    p = w if self.code[w] == "(" else self.code.find("(", w)
                    close = self.scan.match.get(p)
                    arrow = close is not None and re.compile(r"\s*(?::[^=;{]*(?:\{[^}]*\})?[^=;{]*)?=>").match(self.code, close + 1)
                if arrow:
                    tail = len(self.text[at:stop].rstrip().rstrip(";").rstrip())
                    self.add("function", m["n"], at, at + tail, at + tail, doc_at, is_async)
            at = self.next_code(stop + 1, end) if stop < end else end

    def run(self) -> None:
        src = self.src
        errors = sorted({self.line(k) for k in self.scan.errors})
        found, imports, at, end = [], [], self.next_code(0), len(self.code)
        while at < end:
            m = _START.match(self.code, at)
            i = _IMPORT.match(self.code, at)
            if i and not (m and m["class"]):
                # from … to the end of the statement; the string of the source ends it
                q = re.compile(r"['\"][^'\"\n]*['\"]").search(self.text, at)
                stop = self.statement_end(q.end() if q else i.end(), end)
                imports.append((self.line(at), self.line(max(at, stop - 1)), self.text[at:stop].strip()))
                at = self.next_code(max(stop, at + 1))
                continue
            if not m:
                if self.code[at] in _OPEN and at in self.scan.match:
                    stop = self.scan.match[at] + 1
                else:
                    head = self.body(at, end)
                    flat = self.statement_end(at, end)
                    stop = self.scan.match[head] + 1 if head < flat and head in self.scan.match else flat
                at = self.next_code(max(stop, at + 1))
                continue
            begin = m.end("export") if m["export"] else at
            begin = self.next_code(begin)
            if m["var"] or m["alias"]:
                stop = self.statement_end(m.end(), end)
                found.append((m, at, begin, stop, stop))
            else:
                body = self.body(m.end(), end)
                stop = self.scan.match.get(body, None) if body < end else None
                if stop is None:  # no body, or one that is never closed
                    stop, body = self.statement_end(m.end(), end), end
                    if m["class"] or m["iface"] or m["enum"]:
                        body = stop
                else:
                    stop += 1
                found.append((m, at, begin, stop, min(body, stop)))
            at = self.next_code(max(stop, at + 1))
        src.begin_code(imports, errors)
        for m, doc_at, begin, stop, body in found:
            if m["class"]:
                self.add_class(m["cname"], begin, body, stop, doc_at)
            elif m["func"]:
                self.add("function", m["fname"], begin, stop, body, doc_at, m["func"].startswith("async"))
            elif m["iface"]:
                self.add("ts_interface", m["iname"], begin, stop, body, doc_at, False)
            elif m["alias"]:
                self.add("type_alias", m["tname"], begin, stop, stop, doc_at, False)
            elif m["enum"]:
                self.add("enum", m["ename"], begin, stop, body, doc_at, False)
            else:
                self.bindings(m.end(), stop, doc_at)
        src.add_errors(errors)


def script_chunks(src: Source) -> None:
    _Script(src).run()
