"""Named symbols of source files: functions, types and the like, with their lines.

No grammar library is needed. Strings and comments are masked, brackets give the nesting, and a file
falls into statements; what a statement declares is read from its head by the language's patterns.
Python uses its own parser, with an indentation scanner for sources that it rejects; Haskell groups
its top-level lines; LaTeX reads its sections and environments. Sources that don't parse give what
could be read, never an error.
"""

from __future__ import annotations

import ast
import re
import time
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

#: A symbol of more UTF-8 bytes is left out.
MAX_BYTES = 8000
#: Seconds that a file may take; one that is not read by then has no symbols (its line windows remain).
BUDGET_S = 5.0


class _Late(Exception):
    """The time budget of a file is used up."""


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    content: str
    start_line: int
    end_line: int


def split_lines(source: str) -> list[str]:
    """Lines without their ends; a final line end opens no further line."""
    lines = source.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?"
_MASKS = {
    "typescript": re.compile(_C_LIKE + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n']+|[^\\'\n])'", re.S),
    "java": re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|" + _C_LIKE + r"|'(?:\\.|[^'\\\n])*'?", re.S),
    "c": re.compile(_C_LIKE + r"|'(?:\\.|[^'\\\n])*'?", re.S),
    "nix": re.compile(r"\#[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|''.*?(?:''(?![$'\\])|\Z)", re.S),
}


def _mask(source: str, language: str) -> str:
    """The source with strings and comments blanked, line ends kept."""
    return _MASKS[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


class _File:
    def __init__(self, source: str, masked: str):
        self.source, self.masked, self.lines = source, masked, split_lines(source)
        self.out: list[Symbol] = []
        self.starts = [0]
        self.until = time.monotonic() + BUDGET_S
        for m in re.finditer("\n", source):
            self.starts.append(m.end())

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def tick(self) -> None:
        """Called once for each statement or line that a scanner reads."""
        if time.monotonic() > self.until:
            raise _Late

    def emit(self, name: str, kind: str, a: int, b: int, above: tuple[str, ...] = ()) -> None:
        """A symbol over the lines of [a, b), with the lines above that start with one of ``above``."""
        first, last = self.row(a), self.row(max(a, b - 1))
        first = doc_start(self.lines, first, above)
        self.rows(name, kind, first, last)

    def rows(self, name: str, kind: str, first: int, last: int) -> None:
        last = min(last, len(self.lines) - 1)
        content = "\n".join(self.lines[first : last + 1])
        if content.strip():
            self.out.append(Symbol(name, kind, content, first + 1, last + 1))


def doc_start(lines: list[str], row: int, above: tuple[str, ...]) -> int:
    """First of the consecutive lines above ``row`` that start with one of ``above``."""
    while above and row > 0 and lines[row - 1].lstrip().startswith(above):
        row -= 1
    return row


RUST_DOC = ("///", "#[", "//!")
HASKELL_DOC = ("--", "{-")
C_DOC = ("//", "/*", "*")

_OPEN, _CLOSE = "([{", ")]}"


@lru_cache(maxsize=2)
def _brackets(text: str) -> dict[int, int]:
    """Of each opening bracket the place after the one that closes it, whatever their forms."""
    opened: list[int] = []
    ends: dict[int, int] = {}
    for m in re.finditer(r"[(\[{]|[)\]}]", text):
        if m[0] in _OPEN:
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def _close(text: str, at: int, hi: int) -> int:
    """Place after the bracket that closes the one at ``at``, at most ``hi``."""
    return min(_brackets(text).get(at, hi), hi)


_BLANK = re.compile(r"\s*")
_CONTINUES = re.compile(r"(?:[.?:=|&+,)\]*/%<>]|-(?!-)|else\b|catch\b|finally\b|extends\b|implements\b|where\b|as\b|satisfies\b|by\b|\{)")
_UNFINISHED = re.compile(r"(?:[=,(\[{+\-*/%&|?:.<]|=>|->|\bextends|\bimplements|\breturn)$")
#: Characters that tell whether a statement is unfinished, the longest word of ``_UNFINISHED`` and one before it.
_TAIL = len("implements") + 1


def _statements(text: str, lo: int, hi: int, newlines: bool) -> Iterator[tuple[int, int, int]]:
    """(start, end, place of the body's opening brace or -1) of each statement in [lo, hi).

    A statement ends at a semicolon, or behind the brace block that is its body; with ``newlines`` also at
    the end of a line on which nothing stays open. Every character is looked at once.
    """
    i = lo
    while i < hi:
        if text[i].isspace() or text[i] in ";,":
            i += 1
            continue
        a, body, assigned, last = i, -1, False, i
        while i < hi:
            c = text[i]
            if c == ";":
                i += 1
                break
            if c == "{":
                if body < 0:
                    body = i
                i = _close(text, i, hi)
                last = i - 1
                rest = text[i : i + 40]
                if newlines:
                    if not re.match(r"[ \t]*[.,?)\]&|=+(\[]|[ \t\n]*(?:else|catch|finally|as|satisfies)\b|[ \t]*;", rest):
                        break
                elif not assigned:
                    break
                continue
            if c in "([":
                i = _close(text, i, hi)
                last = i - 1
                continue
            if c in ")]}":
                i += 1
                break
            if c == "=":
                assigned = True
            if c == "\n" and newlines:
                ink = _BLANK.match(text, i).end()
                if not _UNFINISHED.search(text[max(a, last + 1 - _TAIL) : last + 1]) and not _CONTINUES.match(text, ink):
                    break
                i = min(ink, hi)
                continue
            if not c.isspace():
                last = i
            i += 1
        yield a, i, body
        if i == a:
            i += 1


_TS = re.compile(r"(?:export\s+|default\s+|declare\s+)*(?P<head>(?:abstract\s+|async\s+|const\s+(?=enum\b))*(?P<kind>function|class|interface|type|enum|const|let|var)\b\s*\*?\s*(?P<name>[\w$]+))")
_TS_KIND = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum"}


def _typescript(f: _File) -> None:
    for a, b, _ in _statements(f.masked, 0, len(f.masked), True):
        f.tick()
        m = _TS.match(f.masked, a, b)
        if not m:
            continue
        start = m.start("head")
        if m["kind"] in _TS_KIND:
            f.emit(m["name"], _TS_KIND[m["kind"]], start, b)
            continue
        at = m.start("name")  # every declarator is a symbol with the whole statement
        for part in _split_top(f.masked, at, b):
            d = re.match(r"\s*([\w$]+)", f.masked[part[0] : part[1]])
            if d:
                f.emit(d[1], "function", start, b)


def _split_top(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    a = i = lo
    while i < hi:
        if text[i] in _OPEN:
            i = _close(text, i, hi)
            continue
        if text[i] == ",":
            yield a, i
            a = i + 1
        i += 1
    yield a, hi


_RUST = re.compile(
    r"(?:#!?\[[^\]]*\]\s*)*(?P<head>(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+(?=(?:unsafe|async|extern|fn)\b)|async\s+|unsafe\s+|extern\s+(?=fn\b|\s)|\s+(?=fn\b))*(?P<kind>fn|struct|enum|trait|type|const|impl|mod)\b\s*(?P<name>[A-Za-z_]\w*)?)"
)
_RUST_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const"}


def _rust(f: _File, lo: int = 0, hi: int | None = None, owner: str | None = None) -> None:
    hi = len(f.masked) if hi is None else hi
    for a, b, body in _statements(f.masked, lo, hi, False):
        f.tick()
        m = _RUST.match(f.masked, a, b)
        if not m:
            continue
        if m["kind"] == "impl":
            head = f.masked[m.end("kind") : body if body >= 0 else b]
            head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head)
            target = re.split(r"\bwhere\b", re.split(r"\bfor\b", head)[-1])[0]
            if body >= 0:
                _rust(f, body + 1, b - 1, target.split("<")[0].strip() or "Unknown")
        elif m["kind"] == "mod":
            if body >= 0:
                _rust(f, body + 1, b - 1, owner)
        elif m["name"]:
            name = f"{owner}::{m['name']}" if owner and m["kind"] == "fn" else m["name"]
            f.emit(name, _RUST_KIND[m["kind"]], m.start("head"), b, RUST_DOC)


_JAVA_TYPE = re.compile(r"(?:@\w[\w.]*(?:\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\b\s*)*(?P<kind>class|interface|enum|@interface|record)\b\s*(?P<name>\w+)")
_JAVA_MEMBER = re.compile(r"(?:@(?!interface)\w[\w.]*(?:\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\b\s*|<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)*(?P<type>[\w.]+(?:<[^()=;]*>)?(?:\s*\[\])*\s+)?(?P<name>\w+)\s*\(")
_JAVA_KIND = {"class": "class", "interface": "interface", "enum": "enum", "@interface": "annotation", "record": "record"}


def _java(f: _File, lo: int = 0, hi: int | None = None, owner: str | None = None, enum: bool = False) -> None:
    hi = len(f.masked) if hi is None else hi
    if enum:  # the constants end at the first semicolon
        end = lo
        while end < hi and f.masked[end] != ";":
            end = _close(f.masked, end, hi) if f.masked[end] in _OPEN else end + 1
        lo = end
    for a, b, body in _statements(f.masked, lo, hi, False):
        f.tick()
        m = _JAVA_TYPE.match(f.masked, a, b)
        if m:
            f.emit(m["name"], _JAVA_KIND[m["kind"]], a, b, C_DOC)
            if body >= 0:
                _java(f, body + 1, b - 1, m["name"], m["kind"] == "enum")
            continue
        m = _JAVA_MEMBER.match(f.masked, a, b) if owner else None
        if m and m["name"] not in ("if", "for", "while", "switch", "return", "new", "super", "this"):
            if m["type"] and m["type"].strip() not in ("new", "return", "throw"):
                f.emit(f"{owner}.{m['name']}", "method", a, b, C_DOC)
            elif not m["type"] and m["name"] == owner and body >= 0:
                f.emit(f"{owner}.{m['name']}", "constructor", a, b, C_DOC)


_KOTLIN_TYPE = re.compile(r"(?:@\w[\w.]*(?:\([^)]*\))?\s*|\b(?:public|protected|private|internal|open|abstract|sealed|data|inner|enum|annotation|value|inline|expect|actual|final|fun)\b\s+)*(?P<kind>class|interface|companion\s+object|object)\b[ \t]*(?P<name>\w+)?")
_KOTLIN_FUN = re.compile(r"(?:@\w[\w.]*(?:\([^)]*\))?\s*|\b[a-z]+\b\s+)*?fun\b\s*(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?(?P<name>\w+)\s*\(")
_KOTLIN_VALUE = re.compile(r"(?:@\w[\w.]*(?:\([^)]*\))?\s*|\b[a-z]+\b\s+)*?(?:val|var)\b\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)")


def _kotlin(f: _File, lo: int = 0, hi: int | None = None, owner: str | None = None) -> None:
    hi = len(f.masked) if hi is None else hi
    dot = f"{owner}." if owner else ""
    for a, b, body in _statements(f.masked, lo, hi, True):
        f.tick()
        m = _KOTLIN_TYPE.match(f.masked, a, b)
        if m and not re.match(r"fun\s*interface", m["kind"]):
            companion = m["kind"].startswith("companion")
            name = m["name"] or ("Companion" if companion else None)
            if name:
                f.emit(dot + name, "object" if "object" in m["kind"] else "class", a, b, C_DOC)
                if body >= 0:
                    _kotlin(f, body + 1, b - 1, dot + name)
            continue
        m = _KOTLIN_FUN.match(f.masked, a, b)
        if m:
            f.emit(dot + m["name"], "method" if owner else "function", a, b, C_DOC)
            continue
        m = _KOTLIN_VALUE.match(f.masked, a, b)
        if m:
            f.emit(dot + m["name"], "property", a, b, C_DOC)


_C_NESTED = re.compile(r"(?:inline\s+)?namespace\b[^{;=]*(?=\{)|extern\s*(?=\{)")
_C_TAGGED = re.compile(r"(?:(?:static|const|extern|volatile)\s+)*(?P<kind>struct|union|enum(?:\s+(?:class|struct))?|class)\b\s*(?:\[\[[^\]]*\]\]\s*|\w+\([^)]*\)\s*)*(?P<name>\w+)?[^(){};=]*(?=\{)")
_C_FUNCTION = re.compile(r"[^=;{}]*?(?P<name>~?[\w:]+|operator\s*[^\s(]+)\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|volatile|->\s*[\w:<>*& ]+|:\s*[^{;]*|\s)*\{")


def _c(f: _File, lo: int = 0, hi: int | None = None) -> None:
    hi = len(f.masked) if hi is None else hi
    for a, b, body in _statements(f.masked, lo, hi, False):
        f.tick()
        head = f.masked[a : body if body >= 0 else b]
        label = re.match(r"(?:public|protected|private)\s*:\s*", head)
        if label:
            a += label.end()
        template = re.match(r"template\s*<(?:[^<>]|<[^<>]*>)*>\s*", f.masked[a:b])
        inner = a + (template.end() if template else 0)
        if _C_NESTED.match(f.masked, inner, b) and body >= 0:
            _c(f, body + 1, b - 1)
            continue
        text = f.masked[inner:b]
        if text.startswith("typedef"):
            end = f.masked.find(";", b - 1, hi) if not text.rstrip().endswith(";") else b
            end = b if end < 0 else max(b, end + 1)
            m = re.search(r"(?:\(\s*\*\s*(\w+)\s*\)\s*\([^;]*|(\w+)\s*(?:\[[^\]]*\])?)\s*;?\s*$", f.masked[inner:end].rstrip().rstrip(";"))
            if m:
                f.emit(m[1] or m[2], "type", inner, end, C_DOC)
            continue
        m = _C_TAGGED.match(f.masked, inner, b)
        if m and body >= 0:
            kind = m["kind"].split()[0]
            if m["name"]:
                f.emit(m["name"], {"struct": "struct", "union": "struct", "enum": "enum", "class": "class"}[kind], inner, b, C_DOC)
            if kind == "class":
                _c(f, body + 1, _close(f.masked, body, b) - 1)
            continue
        m = _C_FUNCTION.match(f.masked, inner, b) if body >= 0 else None
        if m and "::" not in m["name"] and m["name"] not in ("if", "for", "while", "switch") and not m["name"].startswith(("~", "operator")):
            f.emit(m["name"], "function", inner, b, C_DOC)


def _c_file(source: str) -> _File:
    """Preprocessor lines are read first and blanked."""
    masked = _mask(source, "c")
    f = _File(source, masked)
    chars = list(masked)
    for m in re.finditer(r"^[ \t]*#[ \t]*(\w+)[ \t]*(\w+)?(?:[^\\\n]|\\\n|\\.)*$", masked, re.M):
        if m[1] == "define" and m[2]:
            f.emit(m[2], "const", m.start(), m.end())
        for i in range(m.start(), m.end()):
            if chars[i] != "\n":
                chars[i] = " "
    f.masked = "".join(chars)
    return f


def _python(source: str, f: _File) -> None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indent(f)

    def top(n: ast.AST) -> int:
        return min([n.lineno, *[d.lineno for d in n.decorator_list]]) - 1

    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            f.rows(n.name, "function", top(n), n.end_lineno - 1)
        elif isinstance(n, ast.ClassDef):
            f.rows(n.name, "class", top(n), n.end_lineno - 1)
            for k in n.body:
                if isinstance(k, ast.FunctionDef | ast.AsyncFunctionDef):
                    f.rows(f"{n.name}.{k.name}", "method", top(k), k.end_lineno - 1)
    return None


def _python_by_indent(f: _File) -> None:
    """For sources that don't parse: a block goes on while lines are blank or indented deeper."""
    i, lines, owner = 0, f.lines, None
    while i < len(lines):
        f.tick()
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", lines[i])
        if not m:
            if lines[i].strip() and not lines[i][0].isspace() and not lines[i].startswith(("@", "#")):
                owner = None
            i += 1
            continue
        depth = len(m[1])
        end = i
        for j in range(i + 1, len(lines)):
            s = lines[j]
            if s.strip() and len(s) - len(s.lstrip()) <= depth and not s.lstrip().startswith((")", "]", "}")):
                break
            if s.strip():
                end = j
        first = doc_start(lines, i, ("@",))
        if depth == 0:
            f.rows(m[3], "function" if m[2] == "def" else "class", first, end)
            owner = m[3] if m[2] == "class" else None
            i = i + 1 if owner else end + 1
        else:
            if owner and m[2] == "def":
                f.rows(f"{owner}.{m[3]}", "method", first, end)
            i = end + 1


_HS_WORD = re.compile(r"(?P<sig>\(?[\w']+\)?(?:\s*,\s*\(?[\w']+\)?)*|\([^\w\s()]+\))\s*::|(?P<kw>type\s+(?:family|instance)|type|data\s+(?:family|instance)|data|newtype|class|instance|deriving\s+instance|foreign|infix[lr]?|pattern|default|import|module)\b|(?P<name>[a-z_][\w']*)(?=[^\w'])|.*?`(?P<op>[\w']+)`")


def _haskell(f: _File) -> None:
    """Top-level declarations: a line without indentation opens one, indented lines belong to it."""
    decls: list[tuple[str, str | None, int, int]] = []
    lines, i, comment = f.lines, 0, 0
    while i < len(lines):
        f.tick()
        s = lines[i]
        if comment or s.startswith("{-"):
            comment = max(0, comment + s.count("{-") - s.count("-}"))
            i += 1
            continue
        if not s.strip() or s[0].isspace() or s.startswith(("--", "#")):
            i += 1
            continue
        end = i
        for j in range(i + 1, len(lines)):
            t = lines[j]
            if t.strip() and (not t[0].isspace() or t.startswith("#")):
                break
            if t.strip() and not t.lstrip().startswith("--"):
                end = j
        m = _HS_WORD.match(s + " ")
        if m:
            if m["kw"]:
                kw = m["kw"].split()[0]
                rest = s[m.end("kw") :]
                rest = re.sub(r"^.*?=>\s*", "", rest) if kw in ("class", "data", "newtype") and "=>" in rest.split("=", 1)[0] + "=>" and "=>" in rest.split(" where")[0] else rest
                name = re.match(r"\s*\(?\s*([A-Z][\w']*)", rest)
                if kw == "instance":
                    inst = re.sub(r"^.*?=>\s*", "", rest.split(" where")[0])
                    name = re.match(r"\s*([A-Z][\w'.]*)", inst)
                decls.append((kw, name[1] if name else None, i, end))
            elif m["sig"]:
                decls.append(("signature", re.split(r"[\s,]", m["sig"].strip("() "))[0], i, end))
            else:
                decls.append(("function", m["name"] or m["op"], i, end))
        i = end + 1
    kinds = {"type": "type", "data": "struct", "newtype": "struct", "class": "class", "instance": "impl"}
    k = 0
    while k < len(decls):
        kind, name, a, b = decls[k]
        k += 1
        if kind in ("signature", "function"):
            while k < len(decls) and decls[k][0] == "function" and decls[k][1] == name:
                b = decls[k][3]
                k += 1
            if name:
                f.rows(name, "function", doc_start(lines, a, HASKELL_DOC), b)
        elif kind in kinds and (name or kind in ("class", "instance")):
            f.rows(name or f"{kind}@L{a + 1}", kinds[kind], doc_start(lines, a, HASKELL_DOC), b)


def _nix(f: _File) -> None:
    text, at, n = f.masked, 0, len(f.masked)

    def bindings(lo: int, hi: int) -> None:
        i = lo
        while i < hi:
            f.tick()
            m = re.compile(r"\s*(inherit\b[^;]*;|(?P<name>(?:[\w'.\-${}]|\"|\s(?=[.\"]))+?)\s*=(?!=))").match(text, i, hi)
            if not m:
                i += 1
                continue
            if m["name"] is None and not m.group().strip().endswith("="):
                i = m.end()
                continue
            j = m.end()
            while j < hi and text[j] != ";":
                if text[j] in _OPEN:
                    j = _close(text, j, hi)
                    continue
                if re.match(r"\blet\b", text[j : j + 4]) and not text[j - 1].isalnum():
                    k = _let_end(text, j + 3, hi)
                    j = k
                    continue
                j += 1
            a = m.start("name")
            name = f.source[a : m.end("name")].strip()
            if name:
                f.emit(name, "binding", a, min(j + 1, hi))
            i = j + 1

    def _skip() -> None:
        nonlocal at
        while at < n and text[at].isspace():
            at += 1

    for _ in range(64):
        _skip()
        if at >= n:
            return
        if re.match(r"let\b", text[at:]):
            end = _let_end(text, at + 3, n)
            bindings(at + 3, max(at + 3, end - 2))
            at = end
        elif m := re.match(r"(?:with|assert)\b", text[at:]):
            at = text.find(";", at) + 1 or n
        elif m := re.match(r"rec\s*(?=\{)", text[at:]):
            at += m.end()
        elif text[at] == "{":
            end = _close(text, at, n)
            m = re.match(r"\s*(?:@\s*\w+\s*)?:", text[end:])
            if m:
                at = end + m.end()
                continue
            bindings(at + 1, end - 1)
            return
        elif m := re.match(r"[\w'\-]+\s*(?:@\s*(?=\{))", text[at:]):
            at += m.end()
        elif m := re.match(r"[\w'\-]+\s*:", text[at:]):
            at += m.end()
        else:
            return


def _let_end(text: str, at: int, hi: int) -> int:
    """Place after the ``in`` of a let."""
    depth = 1
    while at < hi:
        if text[at] in _OPEN:
            at = _close(text, at, hi)
            continue
        m = re.match(r"(let|in)\b", text[at : at + 4])
        if m and not (at and (text[at - 1].isalnum() or text[at - 1] in "_-'.")):
            depth += 1 if m[1] == "let" else -1
            at += len(m[1])
            if not depth:
                return at
            continue
        at += 1
    return hi


_TEX_LEVEL = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_TEX_CLAIMS = frozenset("theorem lemma definition corollary proposition proof remark example conjecture axiom claim observation".split())
_TEX_MATH = frozenset("equation align gather multline eqnarray displaymath math alignat flalign".split())


def _latex(f: _File) -> None:
    text = re.sub(r"(?<!\\)%[^\n]*", lambda m: " " * len(m.group()), f.source)
    heads = [(m.start(), m[1], m[2].strip()) for m in re.finditer(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", text)]
    stop = m.start() if (m := re.search(r"\\end\{document\}", text)) else len(text)
    found: list[tuple[int, int, str, str]] = []
    # the next head of each level or of one above it, from the last head to the first
    after = dict.fromkeys(_TEX_LEVEL.values(), stop)
    for a, kind, title in reversed(heads):
        f.tick()
        level = _TEX_LEVEL[kind]
        b = after[level]
        while b > a and text[b - 1].isspace():
            b -= 1
        found.append((a, b, kind, title or f"{kind}@L{f.row(a) + 1}"))
        after = {k: a if k >= level else v for k, v in after.items()}
    covered = 0
    stack: list[tuple[str, int]] = []
    spans = []
    for m in re.finditer(r"\\(begin|end)\{([A-Za-z]+\*?)\}", text):
        if m[1] == "begin":
            stack.append((m[2], m.start()))
        elif stack and stack[-1][0] == m[2]:
            env, a = stack.pop()
            spans.append((a, m.end(), env))
    at = 0
    while m := re.compile(r"\\\[|\$\$").search(text, at):
        close = text.find("\\]" if m[0] == "\\[" else "$$", m.end())
        at = m.end() if close < 0 else close + 2
        if close >= 0:
            spans.append((m.start(), at, "displaymath"))
        elif "\\]" not in text[at:] and "$$" not in text[at:]:
            break
    for a, b, env in sorted(spans, key=lambda s: (s[0], -s[1])):
        f.tick()
        if b <= covered:
            continue
        name, body = env.rstrip("*"), text[a:b]
        label = re.search(r"\\label\{([^}]*)\}", body)
        if name in ("figure", "table"):
            caption = re.search(r"\\caption(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", body)
            found.append((a, b, "figure", caption[1].strip() if caption else label[1].strip() if label else f"{env}@L{f.row(a) + 1}"))
        elif name in _TEX_CLAIMS:
            found.append((a, b, name, label[1].strip() if label else f"{env}@L{f.row(a) + 1}"))
        elif name in _TEX_MATH:
            if f.row(b - 1) > f.row(a):
                found.append((a, b, "equation", f"equation@L{f.row(a) + 1}"))
        else:
            continue
        covered = max(covered, b)
    for a, b, kind, name in sorted(found, key=lambda x: (x[0], -x[1])):
        f.emit(name, kind, a, b)


def extract_symbols(source: str, language: str) -> list[Symbol]:
    """Symbols in the order of the file; none for other languages, empty sources and files beyond the time budget."""
    if not source.strip():
        return []
    try:
        found = _extract(source, language)
    except _Late:
        return []
    return [s for s in found if len(s.content.encode()) <= MAX_BYTES]


def _extract(source: str, language: str) -> list[Symbol]:
    if language in ("typescript", "javascript"):
        _typescript(f := _File(source, _mask(source, "typescript")))
    elif language == "python":
        _python(source, f := _File(source, source))
    elif language == "rust":
        _rust(f := _File(source, _mask(source, "rust")))
    elif language == "haskell":
        _haskell(f := _File(source, source))
    elif language == "latex":
        _latex(f := _File(source, source))
    elif language == "nix":
        _nix(f := _File(source, _mask(source, "nix")))
    elif language in ("c", "cpp"):
        _c(f := _c_file(source))
        f.out.sort(key=lambda s: s.start_line)
    elif language == "java":
        _java(f := _File(source, _mask(source, "java")))
    elif language == "kotlin":
        _kotlin(f := _File(source, _mask(source, "java")))
    else:
        return []
    return f.out
