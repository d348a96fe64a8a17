"""What the parsers share: source with comments and strings blanked out, brackets, symbols and calls."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import Generic, TypeVar

T = TypeVar("T")


class Spans(Generic[T]):
    """Spans that lie within or beside one another, each with a value."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.rows: list[tuple[int, int, T]] = []
        self.around: list[int] = []  # number of the span around each, -1 for none

    def add(self, start: int, end: int, value: T) -> None:
        if self.starts and start < self.starts[-1]:  # rare: what comes first in a file is found first
            rows = sorted([*self.rows, (start, end, value)], key=lambda r: r[0])
            self.__init__()
            for r in rows:
                self.add(*r)
            return
        self.around.append(self._number(start))
        self.starts.append(start)
        self.rows.append((start, end, value))

    def _number(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        while k >= 0 and self.rows[k][1] < at:
            k = self.around[k]
        return k

    def row(self, at: int) -> tuple[int, int, T] | None:
        """(start, end, value) of the innermost span around ``at``."""
        k = self._number(at)
        return self.rows[k] if k >= 0 else None

    def find(self, at: int) -> T | None:
        found = self.row(at)
        return found[2] if found else None


@dataclass
class Symbol:
    id: str
    name: str
    kind: str
    qualified_name: str
    file_path: str
    start: int
    end: int
    signature: str
    doc_comment: str | None


@dataclass
class Call:
    caller_id: str
    callee_name: str
    at: int
    call_kind: str | None = None
    receiver_expr: str | None = None
    receiver_type: str | None = None
    package_or_namespace: str | None = None
    import_hint: str | None = None


@dataclass
class Source:
    """A file's text, and ``code``: the same length, with comments and the insides of strings as spaces."""

    path: str
    text: str
    strings: str
    code: str = ""
    comments: list[tuple[int, int]] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)

    def __post_init__(self) -> None:
        out, last = [], 0
        for m in re.finditer(self.strings, self.text, re.S):
            if m.lastgroup == "comment":
                self.comments.append(m.span())
                keep = re.sub(r"[^\n]", " ", m[0])
            else:
                keep = m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]
            out += [self.text[last : m.start()], keep]
            last = m.end()
        self.code = "".join([*out, self.text[last:]])
        self.comment_ends = {a + len(self.text[a:b].rstrip()): a for a, b in self.comments}
        self.line_starts = [0, *[m.end() for m in re.finditer("\n", self.text)]]
        self.plain = self.text.isascii()
        self.last_place = (0, 0, 0)
        self.brackets()

    def brackets(self) -> None:
        """``match``: the closing bracket of each opening one; what stays open ends with the file. ``opening``: the reverse."""
        self.match: dict[int, int] = {}
        pairs = {")": "(", "]": "[", "}": "{"}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m[0]
            if c in "([{":
                stack.append(m.start())
                continue
            while stack and self.code[stack[-1]] != pairs[c]:
                if c != "}":
                    break
                self.match[stack.pop()] = m.start()
            if stack and self.code[stack[-1]] == pairs[c]:
                self.match[stack.pop()] = m.start()
        for at in stack:
            self.match[at] = len(self.code) - 1
        self.opening: dict[int, int] = {}
        for a, b in self.match.items():
            self.opening.setdefault(b, a)
        self.braces: Spans[None] = Spans()
        for a in sorted(a for a in self.match if self.code[a] == "{"):
            self.braces.add(a, self.match[a], None)

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1 and column in bytes from 0."""
        line = bisect_right(self.line_starts, at)
        start = self.line_starts[line - 1]
        if self.plain:
            return line, at - start
        # on from the place asked before, if that is on the same line: lines can be very long
        known, column = self.last_place[1:] if self.last_place[0] == line and self.last_place[1] <= at else (start, 0)
        column += len(self.text[known:at].encode())
        self.last_place = (line, at, column)
        return line, column

    def before(self, at: int, n: int = 16) -> str:
        """The last ``n`` characters of code before ``at``, white space behind them left out."""
        end = self.end_before(at)
        return self.code[max(0, end - n) : end]

    def end_before(self, at: int) -> int:
        while at and self.code[at - 1].isspace():
            at -= 1
        return at

    def doc(self, start: int) -> str | None:
        """The comments that stand right before ``start``, with their marks, attributes and annotations aside."""
        ends = self.comment_ends
        found, at = [], start
        while True:
            low = max(0, at - 20_000)
            head = self.text[low:at].rstrip()
            pos = low + len(head)
            begin = ends.get(pos)
            if begin is not None:
                line = self.text[self.line_starts[bisect_right(self.line_starts, begin) - 1] : begin]
                if line.strip():
                    break
                found.append(self.text[begin:pos].rstrip())
                at = begin
                continue
            aside = re.search(r"(?:#!?\[[^\n]*\]|@[\w.]+(?:\([^\n]*\))?)\Z", head[head.rfind("\n") + 1 :])
            if not aside:
                break
            at = pos - len(aside[0])
        return "\n".join(reversed(found)) or None

    def add(self, name: str, kind: str, qualified: str, start: int, body: int | None, end: int, own_id: str | None = None, prefix: str = "") -> str:
        head = self.text[start : body if body is not None else end].strip().removesuffix("{").strip()
        if not head:
            head = self.text[start:end].split("\n")[0]
        ident = own_id or f"{self.path}::{qualified}"
        self.symbols.append(Symbol(ident, name, kind, qualified, self.path, start, end, prefix + head, self.doc(start)))
        return ident

    def rows(self) -> tuple[list[tuple], list[tuple]]:
        nodes = []
        for s in self.symbols:
            (l1, c1), (l2, c2) = self.place(s.start), self.place(max(s.start, s.end))
            nodes.append((s.id, s.name, s.kind, s.qualified_name, s.file_path, l1, l2, c1, c2, s.signature, s.doc_comment))
        calls = []
        for c in self.calls:
            line, column = self.place(c.at)
            scope, _, simple = c.callee_name.rpartition("::")
            calls.append((c.caller_id, c.callee_name, simple, scope or None, c.call_kind, c.receiver_expr, c.receiver_type, c.package_or_namespace, c.import_hint, line, column))
        return nodes, calls


def squeezed(text: str) -> str:
    return re.sub(r"\s+", "", text)


def join(parent: str | None, name: str) -> str:
    return f"{parent}::{name}" if parent else name
