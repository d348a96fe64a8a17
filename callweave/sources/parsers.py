"""Structural parsers: symbols and call sites of Rust, Go, Java, C, C++ and Zig.

They read declarations and brackets of source whose comments and strings are blanked out; they don't build syntax
trees, so spans can differ from a grammar's by a few characters. Calls outside of functions are not recorded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import schema
from callweave.sources.lexer import Call, Source, Spans, join, squeezed

C_STRINGS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'"
RUST_STRINGS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|r(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.[^']*|[^'\\\n])'"
GO_STRINGS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^']*|[^'\\\n])'"
JAVA_STRINGS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^']*|[^'\\\n])'"
ZIG_STRINGS = r"(?P<comment>//[^\n]*)|\\\\[^\n]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'"

#: Words before a bracket that don't call, in C and its like and in the other languages besides.
NOT_CALLED = frozenset("if else while for switch return catch sizeof alignof typeof new super this case synchronized throw assert do try".split())
NOT_CALLED_HERE = NOT_CALLED | frozenset("match fn func loop in as move unsafe defer go select".split())


def _body(s: Source, at: int, stop: str = ";", end: int | None = None) -> int | None:
    """The next opening brace at the level of ``at``, unless ``stop`` comes first, or ``end``."""
    marks = re.compile(f"[{{(\\[{stop}]")
    while m := marks.search(s.code, at, len(s.code) if end is None else end):
        if m[0] == "{":
            return m.start()
        if m[0] in stop:
            return None
        at = s.match.get(m.start(), m.start()) + 1
    return None


def rust(path: str, text: str) -> Source:
    s = Source(path, text, RUST_STRINGS)
    impls: Spans[str] = Spans()
    functions: Spans[str] = Spans()
    for m in re.finditer(r"\bimpl\b", s.code):
        body = _body(s, m.end())
        if body is None:
            continue
        head = re.sub(r"\bwhere\b.*", "", s.code[m.end() : body], flags=re.S).strip()
        if head.startswith("<"):
            depth = 0
            for k, c in enumerate(head):
                depth += (c == "<") - (c == ">" and head[k - 1] != "-")
                if not depth:
                    head = head[k + 1 :].strip()
                    break
        owner = re.split(r"\bfor\b", head)[-1].strip()
        impls.add(body, s.match[body], owner)
    for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?\b(?:unsafe\s+)?(struct|enum|trait)\s+(\w+)", s.code):
        body = _body(s, m.end())
        semi = s.code.find(";", m.end()) if body is None else 0
        end = s.match[body] + 1 if body is not None else semi + 1 if semi >= 0 else len(s.code)
        s.add(m[2], m[1], m[2], m.start(), body if body is not None else end, end)
    for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:const|async|unsafe|default)\s+|\bextern\s*(?:\"[^\"]*\"\s*)?)*\bfn\s+(\w+)", s.code):
        body = _body(s, m.end())
        if body is None:
            continue
        owner = impls.find(m.start())
        # a function within a function isn't a method of the outer one's type
        ident = s.add(m[1], "method" if owner else "function", join(owner, m[1]), m.start(), body, s.match[body] + 1)
        functions.add(body, s.match[body], ident)
    for m in re.finditer(r"((?:\w+(?:::<[^<>()]*(?:<[^<>]*>[^<>()]*)*>)?\s*::\s*)*\w+(?:\s*::\s*<[^<>()]*(?:<[^<>]*>[^<>()]*)*>)?)\s*\(", s.code):
        name = squeezed(m[1])
        before = s.before(m.start())
        if name in NOT_CALLED_HERE or re.search(r"\bfn\Z|\b(?:struct|enum)\Z", before):
            continue
        caller = functions.find(m.start())
        if caller:
            field = before.endswith(".") and not before.endswith("..")
            s.calls.append(Call(caller, re.sub(r"::<.*", "", name) if field else name, m.start()))
    return s


def go(path: str, text: str) -> Source:
    s = Source(path, text, GO_STRINGS)
    package = re.search(r"^\s*package\s+(\w+)", s.code, re.M)
    pkg = package[1] if package else None
    imports: dict[str, str] = {}
    for m in re.finditer(r"^\s*import\s*(\(|(?:[\w.]+\s+)?\")", s.code, re.M):
        block = s.text[m.end() : s.match[m.end() - 1]] if m[1] == "(" else s.text[m.start(1) : s.text.find("\n", m.start(1)) % (len(s.text) + 1)]
        for alias, target in re.findall(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", block):
            imports[alias or target.rsplit("/", 1)[-1]] = target
    for m in re.finditer(r"^\s*type\s*(\(\s*)?(\w+)(?:\[[^\]\n]*\])?\s+(struct|interface)\b", s.code, re.M):
        body = _body(s, m.end())
        if body is not None:
            s.add(m[2], m[3], m[2], m.start(2), body, s.match[body] + 1, prefix="type ")
            s.symbols[-1].doc_comment = s.doc(m.start() + len(m[0]) - len(m[0].lstrip()))
    functions: Spans[str] = Spans()
    for m in re.finditer(r"^func\s*(\([^)]*\))?\s*(\w+)", s.code, re.M):
        after = s.code.find("\nfunc", m.end())
        body = _body(s, m.end(), "", after if after >= 0 else None)
        if m[1] and (t := re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*\)\Z", m[1])):
            qualified, kind = f"{t[1]}::{m[2]}", "method"
        else:
            qualified, kind = m[2], "function"
        line_end = s.code.find("\n", m.end()) % (len(s.code) + 1)
        end = s.match[body] + 1 if body is not None else line_end
        ident = s.add(m[2], kind, qualified, m.start(), body, end)
        if body is not None:
            functions.add(body, s.match[body], ident)
    for m in re.finditer(r"(?<![\w.])((?:\w+(?:\([^()]*\))?\s*\.\s*)*)(\w+)(?:\[[^\]\n]*\])?\(", s.code):
        if m[2] in NOT_CALLED_HERE or not (caller := functions.find(m.start())):
            continue
        receiver = squeezed(m[1]).rstrip(".") or None
        s.calls.append(Call(caller, m[2], m.start(), "method" if receiver else "function", receiver, None, pkg, imports.get(receiver or "")))
    return s


#: Annotations that map requests, and the verb of each.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": None}


def _annotations(s: Source, start: int) -> list[tuple[str, str]]:
    """(name, arguments) of the annotations right before ``start``, in order."""
    out, at = [], start
    while True:
        end = s.end_before(at)
        args, named = "", end
        if s.code[end - 1 : end] == ")":
            if (named := s.opening.get(end - 1)) is None:
                return out[::-1]
            args = s.text[named + 1 : end - 1]
            named = s.end_before(named)
        m = re.search(r"@([\w.]+)\Z", s.code[max(0, named - 200) : named])
        if not m:
            return out[::-1]
        out.append((m[1].rsplit(".", 1)[-1], args))
        at = named - len(m[0])


def _paths(args: str) -> list[str]:
    """Paths of a mapping: a bare string, or value= or path= with a string or several."""
    named = re.search(r"\b(?:value|path)\s*=\s*(\{[^}]*\}|\"[^\"]*\")", args)
    if named:
        return re.findall(r"\"([^\"]*)\"", named[1])
    bare = re.match(r"\s*\"([^\"]*)\"", args)
    return [bare[1]] if bare else []


def _verbs(name: str, args: str) -> list[str]:
    if MAPPINGS[name]:
        return [MAPPINGS[name]]
    given = re.search(r"\bmethod\s*=\s*(\{[^}]*\}|[\w.]+)", args)
    return re.findall(r"(?:\w+\.)*([A-Z]+)\b", given[1]) if given else ["ANY"]


def _combined(a: str, b: str) -> str:
    return "/" + "/".join(x for x in (a.strip("/"), b.strip("/")) if x)


JAVA_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|sealed|strictfp|default|synchronized|native|transient|volatile)\s+)*"


JAVA_TAIL = re.compile(r"\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s]+)?\s*([{;])")


def java(path: str, text: str) -> Source:
    s = Source(path, text, JAVA_STRINGS)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", s.code, re.M)
    pkg = package[1] if package else None
    imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", s.code, re.M)
    hint = lambda name: next((i for i in imports if name and (i == name or i.endswith(f".{name}"))), None)
    classes: Spans[tuple[str, str]] = Spans()
    controllers: dict[str, list[str]] = {}
    types: Spans[str] = Spans()
    for m in re.finditer(rf"({JAVA_MODIFIERS})\b(class|interface|enum|record|@interface)\s+(\w+)", s.code):
        body = _body(s, m.end())
        if body is None or s.before(m.start()).endswith("."):
            continue
        outer = classes.find(m.start())
        types.add(body, s.match[body], m[3])
        if m[2] not in ("class", "interface"):
            continue
        qualified = join(outer[0] if outer else pkg, m[3])
        notes = _annotations(s, m.start())
        start = s.text.rfind("@" + notes[0][0], 0, m.start()) if notes else m.start()
        s.add(m[3], m[2], qualified, start, body, s.match[body] + 1)
        classes.add(body, s.match[body], (qualified, m[3]))
        if any(n in ("Controller", "RestController") for n, _ in notes):
            controllers[qualified] = [p for n, a in notes if n == "RequestMapping" for p in _paths(a)] or [""]
    declared = r"\b((?:[A-Z][\w.]*|int|long|double|float|boolean|char|byte|short|var)(?:<[^;{}()=]*?>)?(?:\[\])*)\s+(\w+)\s*(?=[=;,):])"
    fields: dict[str, dict[str, str]] = {}
    for m in re.finditer(declared, s.code):
        if (own := classes.find(m.start())) is not None:
            fields.setdefault(own[0], {})[m[2]] = re.sub(r"<.*", "", m[1])
    methods: Spans[tuple[str, str, dict[str, str]]] = Spans()
    declarations: set[int] = set()
    for m in re.finditer(rf"({JAVA_MODIFIERS})(?:<[^;{{}}()]*>\s*)?(?:([\w.]+(?:<[^;{{}}()=]*>)?(?:\[\])*)\s+)?(\w+)\s*\(", s.code):
        own = classes.find(m.start())
        close = s.match.get(m.end() - 1)
        if own is None or close is None or m[3] in NOT_CALLED or m[2] in ("new", "return", "throw", "else", "case"):
            continue
        inner, brace = types.row(m.start()), s.braces.row(m.start())
        if brace and brace[0] > (inner[0] if inner else -1) or s.before(m.start())[-1:] in (".", "=", "(", ","):
            continue
        constructor = m[2] is None
        if constructor and m[3] != own[1]:
            continue
        tail = JAVA_TAIL.match(s.code, close + 1)
        if not tail:
            continue
        body = tail.start(1) if tail[1] == "{" else None
        end = s.match[body] + 1 if body is not None else tail.end()
        declarations.add(m.start(3))
        notes = _annotations(s, m.start())
        start = s.text.rfind("@" + notes[0][0], 0, m.start()) if notes else m.start()
        qualified = join(own[0], m[3])
        ident = s.add(m[3], "constructor" if constructor else "method", qualified, start, body, end)
        scope = dict(fields.get(own[0], {}))
        if body is not None:
            for d in re.finditer(declared, s.code[m.end() - 1 : end]):
                scope[d[2]] = re.sub(r"<.*", "", d[1])
            methods.add(body, s.match[body], (ident, qualified, scope))
        if own[0] in controllers:
            for name, args in notes:
                if name in MAPPINGS:
                    for prefix, p, verb in product(controllers[own[0]], _paths(args) or [""], _verbs(name, args)):
                        route = f"{verb} {_combined(prefix, p)}"
                        rid = s.add(route, "route", route, start, body, end, f"{path}::{qualified}::route::{route}")
                        s.calls.append(Call(rid, qualified, start))
    for m in re.finditer(r"\bnew\s+([\w.]+)(?:<[^;(){}]*>)?\s*\(|((?:(?:\w+|\))(?:\([^()]*\))?\s*\.\s*)*)(?:<[^<>()]*>\s*)?\b(\w+)\s*\(", s.code):
        found = methods.find(m.start())
        if not found or types.row(m.start()) is None:
            continue
        ident, _, scope = found
        if m[1]:
            s.calls.append(Call(ident, m[1], m.start(), "constructor", None, m[1], pkg, hint(m[1])))
            continue
        if m[3] in NOT_CALLED or m.start(3) in declarations:
            continue
        receiver = squeezed(m[2]).removesuffix(".") or None
        kind = scope.get(receiver.removeprefix("this.")) if receiver else None
        s.calls.append(Call(ident, m[3], m.start(), "method", receiver, kind, pkg, hint(kind) or hint(receiver) or (hint(m[3]) if receiver is None else None)))
    return s


C_SCOPE = re.compile(r"\s*(?:final\s*)?(?::[^;{()]*)?\{")
C_TAIL = re.compile(r"\s*(?:const|noexcept|override|final|volatile|&&?|->\s*[\w:<>*&\s]+|__attribute__\s*\(\([^)]*\)\)|\s)*(?::(?!:)[^;{}]*(?:\{[^{}]*\}[^;{}]*)*)?\{")
C_ACCESS = re.compile(r"(?:public|private|protected)\s*:\s*")


def c_like(path: str, text: str) -> Source:
    s = Source(path, text, C_STRINGS)
    s.code = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), s.code, flags=re.M)
    s.brackets()
    ends = [m.start() for m in re.finditer(r"[;{}]", s.code)]
    cpp = path.rsplit(".", 1)[-1].lower() not in ("c", "h")
    scopes: Spans[tuple[str, str]] = Spans()
    parent = lambda at: scopes.find(at)
    for m in re.finditer(r"\b(namespace|class|struct)\s+(?:\[\[[^\]]*\]\]\s*)?(\w+(?:::\w+)*)", s.code):
        if re.search(r"\benum\Z", s.before(m.start())) or (m[1] != "struct" and not cpp) or s.before(m.start())[-1:] in ("<", ","):
            continue
        after = C_SCOPE.match(s.code, m.end())
        body = after.end() - 1 if after else None
        if m[1] == "namespace" and body is None:
            continue
        own = parent(m.start())
        qualified = join(own[0] if own else None, m[2])
        s.add(m[2].rsplit("::", 1)[-1], m[1], qualified, m.start(), body, s.match[body] + 1 if body is not None else m.end())
        if body is not None:
            scopes.add(body, s.match[body], (qualified, m[1]))
    functions: Spans[tuple[str, str | None, set[str]]] = Spans()
    for m in re.finditer(r"(?<![\w.>])((?:\w+(?:<[^<>;{}()]*>)?\s*::\s*)*~?\w+)\s*\(", s.code):
        close = s.match.get(m.end() - 1)
        name = squeezed(m[1])
        if close is None or name in NOT_CALLED:
            continue
        tail = C_TAIL.match(s.code, close + 1)
        if not tail or functions.row(m.start()):
            continue
        body = tail.end() - 1
        k = bisect_left(ends, m.start()) - 1
        start = ends[k] + 1 if k >= 0 else 0
        start += len(s.code[start : m.start()]) - len(s.code[start : m.start()].lstrip())
        access = C_ACCESS.match(s.code, start)
        start = access.end() if access else start
        if "=" in s.code[start : m.start()] and "operator" not in s.code[start : m.start()]:
            continue
        own = parent(m.start())
        method = "::" in name or (own is not None and own[1] in ("class", "struct"))
        ident = s.add(name.rsplit("::", 1)[-1].lstrip("~"), "method" if method else "function", join(own[0] if own else None, name), start, body, s.match[body] + 1)
        pointers = set(re.findall(r"\(\s*\*\s*(\w+)\s*\)\s*\(", s.code[start : s.match[body]]))
        functions.add(body, s.match[body], (ident, own[0] if own else None, pointers))
    for m in re.finditer(r"((?:[\w\]\)]+(?:\([^()]*\))?\s*(?:\.|->)\s*)*)((?:\w+(?:<[^<>;{}()]*>)?\s*::\s*)*\w+)(?:<[^<>;{}()]*>)?\s*\(", s.code):
        found = functions.find(m.start())
        name = squeezed(m[2])
        if not found or name in NOT_CALLED:
            continue
        ident, scope, pointers = found
        receiver = re.sub(r"(?:\.|->)\Z", "", squeezed(m[1])) or None
        letters = [c for c in name if c.isalpha()]
        kind = "method" if receiver else "indirect" if name in pointers else "macro" if letters and all(c.isupper() for c in letters) else "function"
        s.calls.append(Call(ident, name, m.start(), kind, receiver, None, scope))
    return s


def zig(path: str, text: str) -> Source:
    s = Source(path, text, ZIG_STRINGS)
    containers: Spans[str] = Spans()
    functions: Spans[str] = Spans()
    for m in re.finditer(r"(?:\bpub\s+)?\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(struct|enum|union)\b", s.code):
        body = _body(s, m.end())
        if body is not None:
            s.add(m[1], m[2], m[1], m.start(), body, s.match[body] + 1)
            containers.add(body, s.match[body], m[1])
    for m in re.finditer(r"(?:\b(?:pub|export|inline|noinline)\s+)*\bfn\s+(\w+)\s*\(", s.code):
        close = s.match.get(m.end() - 1)
        body = _body(s, close + 1) if close is not None else None
        if body is None:
            continue
        owner = containers.find(m.start())
        ident = s.add(m[1], "method" if owner else "function", join(owner, m[1]), m.start(), body, s.match[body] + 1)
        functions.add(body, s.match[body], ident)
    for m in re.finditer(r"(?<![\w@])((?:\w+\s*\.\s*)*)(\w+)\s*\(", s.code):
        if m[2] in NOT_CALLED_HERE or re.search(r"\bfn\Z", s.before(m.start())):
            continue
        if caller := functions.find(m.start()):
            s.calls.append(Call(caller, m[2], m.start()))
    return s


PARSERS = {"rust": rust, "go": go, "java": java, "c": c_like, "cpp": c_like, "zig": zig}


def parse_code(path: str, content: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, raw calls) in the order of schema.NODES less is_test, and of schema.RAW_CALLS."""
    if language not in PARSERS:
        raise ValueError(f"no parser for {language}")
    return PARSERS[language](path, content).rows()


def parsed(files: DataFrame) -> DataFrame:
    """The columns of schema.FILES, and nodes and calls, of scanned files; null for those without content."""
    node_ddl = ", ".join(c for c in schema.NODES.split(", ") if not c.startswith("is_test"))
    struct = lambda ddl: ",".join(f"{a}:{b}" for a, b in (c.split() for c in ddl.split(", ")))
    names = schema.names(node_ddl), schema.names(schema.RAW_CALLS)
    own = schema.names(schema.FILES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [None if t is None else parse_code(p, t, x) for p, t, x in zip(b["file_path"], b["content"], b["language"], strict=True)]
            rows = [[None if pair is None else [dict(zip(names[k], r, strict=True)) for r in pair[k]] for pair in out] for k in (0, 1)]
            yield b[own].assign(nodes=rows[0], calls=rows[1])

    return files.select(*own, "content").mapInPandas(run, f"{schema.FILES}, nodes array<struct<{struct(node_ddl)}>>, calls array<struct<{struct(schema.RAW_CALLS)}>>")


def nodes_of(found: DataFrame) -> DataFrame:
    """The symbols of ``parsed`` files; of those with one id in a file the last stays."""
    each = found.select(F.col("is_test").alias("test"), F.posexplode("nodes").alias("seq", "n")).select("seq", "n.*", F.col("test").alias("is_test"))
    return each.groupBy("id").agg(F.max_by(F.struct(*schema.names(schema.NODES)), "seq").alias("n")).select("n.*")


def calls_of(found: DataFrame) -> DataFrame:
    return found.select(F.explode("calls").alias("c")).select("c.*")
