"""Extraction of symbols, references and imports from source text, for eleven languages.

Python is read with its own parser (and with an indentation scanner where that
fails); the others with a scanner that blanks strings and comments, matches
brackets, and applies a language's declaration patterns within the blocks it
finds.  The result of a file is a list of rows in pre-order; Spark runs this file
by file in `mapInPandas`.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.schema import EXTRACTED
from graphloom.sources.languages import variant_of_path

#: Called names that are never references, by language.
NOT_CALLS = {
    "javascript": {"super"},
    "rust": {"println", "eprintln", "format", "vec", "assert", "assert_eq"},
    "java": {"super", "this"},
    "c": {"sizeof", "printf", "fprintf", "sprintf", "malloc", "free", "memcpy", "memset", "strlen", "strcmp", "assert", "static_cast", "reinterpret_cast", "dynamic_cast", "const_cast"},
    "csharp": {"base", "this", "nameof", "typeof"},
    "ruby": {"require", "require_relative", "load", "puts", "print", "p", "raise"},
    "php": {"require", "require_once", "include", "include_once", "echo", "isset"},
    "python": set(),
    "go": set(),
}
_FAMILY = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}
_KEYWORDS = set(
    "if for while switch catch return function do else elif try finally case in of and or not await yield typeof instanceof void delete new throw "
    "class struct enum union interface trait impl mod fn func def module namespace using use import package match loop unsafe where as let const var "
    "foreach elseif array list print unless until when rescue ensure begin end then lock fixed checked unchecked sizeof alignof decltype synchronized assert "
    "exit die empty unset eval goto select go defer range chan map type pub static async move dyn ref mut crate self".split()
)


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    exported: bool
    name_at: int = -1
    body: int = -1
    qualified: str | None = None  # set where it does not follow from the scopes


@dataclass
class Reference:
    name: str
    kind: str
    at: int


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    imports: list[tuple[str, str, int]] = field(default_factory=list)  # source, kind, place


def last_identifier(text: str) -> str:
    m = re.search(r"([A-Za-z0-9_$]+)[^A-Za-z0-9_$]*$", text)
    return m[1] if m else ""


_TOKENS = {
    "javascript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'",
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<h>#*)\".*?(?:\"(?P=h)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.[^'\n]*|[^'\\\n])'",
    "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "csharp": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\$?@\$?\"(?:\"\"|[^\"])*(?:\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "ruby": r"#[^\n]*|^=begin.*?(?:^=end|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)",
    "php": r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)",
    "python": r"#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)",
}
_TOKENS = {k: re.compile(v, re.S | re.M) for k, v in _TOKENS.items()}


def blank(text: str, family: str) -> str:
    """The text with strings and comments blanked, quotes kept; places and lines stay."""

    def cover(m: re.Match) -> str:
        s = m[0]
        if s[0] in "\"'`" and len(s) > 1 and s[-1] == s[0]:
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return _TOKENS[family].sub(cover, text)


def brackets(code: str) -> dict[int, int]:
    """Opening place to closing place of (), [] and {}; what stays open ends with the text."""
    close, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for m in re.finditer(r"[()\[\]{}]", code):
        c, i = m[0], m.start()
        if c in "([{":
            stack.append((c, i))
        else:
            while stack:
                o, j = stack.pop()
                out[j] = i
                if o == close[c]:
                    break
    for _, j in stack:
        out[j] = len(code) - 1
    return out


def _block(code: str, pairs: dict[int, int], at: int, stop: str = ";") -> tuple[int, int]:
    """From `at`: the next block's start and end, or (-1, end of the statement)."""
    i, n = at, len(code)
    while i < n:
        c = code[i]
        if c == "{":
            return i, pairs.get(i, n - 1) + 1
        if c in "([":
            i = pairs.get(i, i) + 1
            continue
        if c in stop or c == "}":
            return -1, i + (c in stop)
        i += 1
    return -1, n


NAME = r"[A-Za-z_$][\w$]*"
_MODIFIERS = r"(?:(?:@\w+(?:\([^()]*\))?|\[[^\]\n]*\]|public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|readonly|partial|default|synchronized|native|strictfp|extern|unsafe|new|required|open|inline|non-sealed)\s+)*"
_JS_NAME = r"#?[A-Za-z_$][\w$]*"


def _js(code: str, text: str, pairs: dict[int, int]) -> list[Symbol]:
    out: list[Symbol] = []
    exports = [m.end() for m in re.finditer(r"\bexport\s+(?:default\s+)?", code)]
    begins = set(exports)
    for m in re.finditer(rf"(?:(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<f>{NAME})\s*(?=[(<])|(?:\babstract\s+)?\bclass\s+(?P<c>{NAME})(?=[\s{{<]))", code):
        before = code[: m.start()].rstrip()
        if m["f"] and before[-1:] in "=(,:?[&|" and before:
            continue  # an expression
        if m["c"] and before[-1:] in "=(,:?[" and before:
            continue
        body, end = _block(code, pairs, m.end())
        out.append(Symbol(m["f"] or m["c"], "function" if m["f"] else "class", m.start(), end, m.start() in begins, m.start("f") if m["f"] else m.start("c"), body))
    for m in re.finditer(rf"\b(?P<d>const|let|var)\s+(?P<n>{NAME})\s*(?::[^=;\n]*(?:=>[^=;\n]*)?)?=\s*(?P<v>(?:async\s+)?(?:function\b|\(|{NAME}\s*=>|<))", code):
        v = m.start("v")
        rest = code[v:]
        if not re.match(r"(?:async\s+)?function\b", rest):
            i = v + (re.match(r"(?:async\s+)?(?:<[^>]*>\s*)?", rest).end())
            if code[i : i + 1] == "(":
                after = code[pairs.get(i, i) + 1 :]
                if not re.match(r"\s*(?::[^={]*)?=>", after):
                    continue
                head = pairs.get(i, i) + 1 + re.match(r"\s*(?::[^={]*)?=>", after).end()
            elif a := re.match(rf"{NAME}\s*=>", code[i:]):
                head = i + a.end()
            else:
                continue
            brace = re.match(r"\s*\{", code[head:])
            body, end = (head + brace.end() - 1, pairs.get(head + brace.end() - 1, len(code) - 1) + 1) if brace else (-1, _expression_end(code, pairs, head))
        else:
            body, end = _block(code, pairs, v)
        out.append(Symbol(m["n"], "function", m.start("n"), end, m.start() in begins, m.start("n"), body))
    for c in [s for s in out if s.kind == "class" and s.body >= 0]:
        out += _methods(code, pairs, c.body, c.end, rf"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare)\s+)*\*?(?P<n>{_JS_NAME})\s*\??(?=[(<])", c)
    for m in re.finditer(rf"\binterface\s+{NAME}[^{{]*(?=\{{)", code):
        out += _methods(code, pairs, m.end(), pairs.get(m.end(), len(code) - 1), rf"(?P<n>{_JS_NAME})\s*\??(?=[(<])", None)
    spans = [s for s in out if s.exported]
    for s in out:
        s.exported = s.exported or any(e.start <= s.start and s.end <= e.end for e in spans)
    return out


def _expression_end(code: str, pairs: dict[int, int], i: int) -> int:
    n = len(code)
    while i < n:
        c = code[i]
        if c in "([{":
            i = pairs.get(i, i) + 1
            continue
        if c in ";,)]}" or (c == "\n" and not re.match(r"\s*[.?:&|+*=-]", code[i + 1 :]) and code[:i].rstrip()[-1:] not in "=>(,&|?:"):
            return i
        i += 1
    return n


def _top(code: str, pairs: dict[int, int], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches between statements and blocks directly within a block."""
    i = at = start
    while i < end:
        c = code[i]
        if c == "{":
            stop = pairs.get(i, end)
            yield at, i
            i = at = stop + 1
            continue
        if c in "([":
            i = pairs.get(i, i) + 1
            continue
        if c == ";":
            yield at, i
            at = i + 1
        i += 1
    if code[at:end].strip():
        yield at, end


def _methods(code: str, pairs: dict[int, int], body: int, end: int, pattern: str, owner: Symbol | None, kind: str = "method") -> list[Symbol]:
    out = []
    for a, b in _top(code, pairs, body + 1, end - 1):
        for m in re.finditer(rf"(?m)(?:^|(?<=\n)|(?<=[\s;}}]))\s*(?P<whole>{pattern})", code[a:b]):
            name, at = m["n"], a + m.start("n")
            line = code.rfind("\n", a, at) + 1 or a
            if name in _KEYWORDS or re.search(r"[=(.]", code[max(a, line) : at]):
                continue
            paren = code.find("(", at, b)
            if paren < 0:
                continue
            close = pairs.get(paren, b)
            block, stop = _block(code, pairs, close + 1, ";\n" if kind == "method" and owner is None else ";")
            out.append(Symbol(name, kind, a + m.start("whole"), stop, False, at, block))
            break
    return out


def _typed(code: str, text: str, pairs: dict[int, int], csharp: bool) -> list[Symbol]:
    """Java and C#: types, and methods and constructors directly within them."""
    words = "class|interface|struct|enum|record(?:\\s+(?:class|struct))?" if csharp else "class|@?interface|enum|record"
    out = []
    for m in re.finditer(rf"(?P<m>{_MODIFIERS})(?<![\w.@])(?P<k>{words})\s+(?P<n>{NAME})", code):
        if code[: m.start("k")].rstrip()[-1:] == ".":
            continue
        body, end = _block(code, pairs, m.end())
        kind = {"@interface": "annotation"}.get(m["k"], m["k"].split()[0])
        out.append(Symbol(m["n"], kind, m.start(), end, bool(re.search(r"\bpublic\b", m["m"])), m.start("n"), body))
    types = [t for t in out if t.body >= 0]
    for t in types:
        for a, b in _top(code, pairs, t.body + 1, t.end - 1):
            m = re.search(rf"(?P<m>{_MODIFIERS})(?P<g><[^<>]*(?:<[^<>]*>)?[^<>]*>\s*)?(?:(?P<t>{NAME}(?:\s*\.\s*{NAME})*(?:\s*<[^;(){{}}]*>)?(?:\s*\[\s*\])*\??)\s+)?(?P<n>{NAME})\s*(?:<[^<>()]*>\s*)?\(", code[a:b])
            if not m or re.search(r"=|\breturn\b|\.\s*$", code[a : a + m.start("n")]) or m["n"] in _KEYWORDS or m["t"] in _KEYWORDS - {"void", "var"}:
                continue
            if not m["t"] and m["n"] != t.name:
                continue
            paren = a + m.end() - 1
            block, end = _block(code, pairs, pairs.get(paren, paren) + 1)
            start = a + m.start() + len(m[0]) - len(m[0].lstrip())
            out.append(Symbol(m["n"], "method" if m["t"] else "constructor", start, end, bool(re.search(r"\bpublic\b", m["m"])), a + m.start("n"), block))
    return out


def _go(code: str, text: str, pairs: dict[int, int]) -> list[Symbol]:
    out = []
    upper = lambda n: n[:1].isascii() and n[:1].isupper()
    for m in re.finditer(rf"(?m)^func\s*(?P<r>\((?P<rt>[^)]*)\)\s*)?(?P<n>{NAME})\s*(?:\[[^\]]*\])?\s*(?=\()", code):
        body, end = _block(code, pairs, m.end(), "\n")
        symbol = Symbol(m["n"], "method" if m["r"] else "function", m.start(), end, upper(m["n"]), m.start("n"), body)
        if m["r"]:
            receiver = re.sub(r"\[.*", "", m["rt"]).replace("*", " ").split()
            symbol.qualified = f"{receiver[-1]}.{m['n']}" if receiver else m["n"]
        out.append(symbol)
    spec = rf"(?P<n>{NAME})\s*(?:\[[^\]]*\]\s*)?(?P<a>=\s*)?(?P<k>struct\b|interface\b|[\w*.\[\](]+)"
    places = [(m.end(), None) for m in re.finditer(r"(?m)^\s*type\s+(?!\()", code)]
    for m in re.finditer(r"(?m)^\s*type\s*\(", code):
        end = pairs.get(m.end() - 1, len(code))
        inner = [x.start() + m.end() for x in re.finditer(rf"(?m)(?<=\n)[ \t]*{NAME}\s+[\w*\[]", code[m.end() : end])]
        depth = [(p, end) for p in inner if code.count("{", m.end(), p) == code.count("}", m.end(), p)]
        places += [(p + len(code[p:]) - len(code[p:].lstrip()), e) for p, e in depth]
    for p, _ in places:
        if (m := re.match(spec, code[p:])) and not m["a"]:
            kind = m["k"] if m["k"] in ("struct", "interface") else "type"
            body, end = _block(code, pairs, p + m.end(), "\n")
            out.append(Symbol(m["n"], kind, p, end if kind != "type" else p + len(code[p:].split("\n", 1)[0]), upper(m["n"]), p, body))
    return out


def _rust(code: str, text: str, pairs: dict[int, int]) -> list[Symbol]:
    out = []
    kinds = {"fn": "function", "mod": "module"}
    for m in re.finditer(rf"(?P<p>\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*\b(?P<k>fn|struct|enum|trait|mod)\s+(?P<n>{NAME})", code):
        body, end = _block(code, pairs, m.end())
        out.append(Symbol(m["n"], kinds.get(m["k"], m["k"]), m.start(), end, bool(m["p"]), m.start("n"), body))
    for m in re.finditer(r"(?m)^\s*(?:unsafe\s+)?impl\b(?P<g>\s*<[^{]*?>(?=\s))?(?P<t>[^{;]*)(?=\{)", code):
        name = re.split(r"\bwhere\b", m["t"])[0]
        name = name.rsplit(" for ", 1)[-1].strip()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append(Symbol(name, "impl", start, pairs.get(m.end(), len(code) - 1) + 1, False, -1, m.end()))
    return out


def _c(code: str, text: str, pairs: dict[int, int], cpp: bool) -> list[Symbol]:
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    out, inside = [], []
    words = "struct|enum(?:\\s+class)?|union" + ("|class|namespace" if cpp else "")
    for m in re.finditer(rf"\b(?P<k>{words})\s+(?:\[\[[^\]]*\]\]\s*|alignas\([^)]*\)\s*)?(?P<n>{NAME}(?:::{NAME})*)\s*(?:final\s*)?(?::[^;{{()]*)?(?=\{{)", code):
        out.append(Symbol(last_identifier(m["n"]), m["k"].split()[0], m.start(), pairs.get(m.end(), len(code) - 1) + 1, True, m.start("n"), m.end()))
    for m in re.finditer(rf"(?P<n>~?{NAME}(?:\s*::\s*~?{NAME})*|operator\s*[^\s(]+)\s*\(", code):
        at = m.start("n")
        if any(a < at < b for a, b in inside):
            continue
        name = last_identifier(m["n"]) or m["n"]
        close = pairs.get(m.end() - 1)
        if close is None or name in _KEYWORDS or name in ("defined", "__attribute__"):
            continue
        after = re.match(r"\s*(?:(?:const|noexcept|override|final|mutable|volatile|&&?|throw\s*\([^)]*\)|->\s*[\w:<>*& ]+)\s*)*(?::(?!:)[^;{]*(?:\{[^{}]*\}[^;{]*)*)?(?=\{)", code[close + 1 :])
        if not after:
            continue
        start = max(code.rfind(c, 0, at) for c in ";{}") + 1
        head = code[start:at]
        if "=" in head or re.search(r"\b(?:return|else|do)\b", head):
            continue
        access = re.match(r"(?:\s*(?:public|private|protected)\s*:(?!:))+", head)
        start += access.end() if access else 0
        start += len(code[start:at]) - len(code[start:at].lstrip())
        brace = close + 1 + after.end()
        end = pairs.get(brace, len(code) - 1) + 1
        inside.append((brace, end))
        out.append(Symbol(name, "function", start, end, not re.search(r"\bstatic\b", head), at, brace))
    return out


def _php(code: str, text: str, pairs: dict[int, int]) -> list[Symbol]:
    out = []
    for m in re.finditer(rf"(?P<m>(?:\b(?:abstract|final|readonly)\s+)*)(?<![\w$>:])\b(?P<k>class|interface|trait|enum)\s+(?P<n>{NAME})", code, re.I):
        if re.search(r"(?:::|->)\s*$", code[: m.start("k")]):
            continue
        body, end = _block(code, pairs, m.end())
        out.append(Symbol(m["n"], m["k"].lower(), m.start(), end, True, m.start("n"), body))
    types = [t for t in out if t.body >= 0]
    for m in re.finditer(rf"(?P<m>(?:\b(?:public|private|protected|static|abstract|final)\s+)*)\bfunction\s+&?\s*(?P<n>{NAME})\s*(?=\()", code, re.I):
        body, end = _block(code, pairs, m.end())
        at = m.start("n")
        owners = [t for t in types if t.body < at < t.end]
        owner = max(owners, key=lambda t: t.body, default=None)
        direct = owner and not any(s.kind in ("function", "method") and s.body > owner.body and s.body < at < s.end for s in out)
        hidden = re.search(r"\b(?:private|protected)\b", m["m"], re.I)
        out.append(Symbol(m["n"], "method" if direct else "function", m.start(), end, not (direct and hidden), at, body))
    return out


_RUBY_OPEN = re.compile(r"(?m)(?P<decl>^[ \t]*(?:(?:private|public|protected|module_function)\s+)?(?P<k>def|class|module)\b)|(?P<start>(?:^|;|=|\()[ \t]*(?:if|unless|while|until|case|begin|for)\b)|(?P<do>\bdo\b)|(?P<end>(?<![.\w:@$])end\b(?![?!:]))")


def _ruby(code: str, text: str, pairs: dict[int, int]) -> list[Symbol]:
    out, stack, loops = [], [], set()
    for m in _RUBY_OPEN.finditer(code):
        if m["decl"]:
            head = code[m.start("k") :]
            d = re.match(rf"(?P<k>def|class|module)\s+(?P<n>(?:self|{NAME})?(?:(?:\.|::)?[A-Za-z_][\w]*[?!=]?|[+\-*/<>=!~\[\]%&|^]+)?)", head)
            at = m.start("k")
            name = d["n"] if d else ""
            if m["k"] == "class" and head[5:].lstrip().startswith("<<"):
                stack.append(None)
                continue
            line = head.split("\n", 1)[0]
            if m["k"] == "def" and re.match(r"def\s+[^\s(=]+(?:\([^)]*\))?\s*=\s", line):
                out.append(Symbol(re.split(r"\.|::", name)[-1], "method", at, at + len(line), True, at + line.find(name), at))
                continue
            stack.append(Symbol(re.split(r"\.|::", name)[-1], {"def": "method"}.get(m["k"], m["k"]), at, len(code), True, at + max(0, line.find(name)), at))
        elif m["start"]:
            stack.append(None)
            if re.search(r"(?:while|until|for)$", m[0]):
                loops.add(code.count("\n", 0, m.end()))
        elif m["do"]:
            if code.count("\n", 0, m.start()) not in loops:
                stack.append(None)
        elif stack:
            s = stack.pop()
            if s:
                s.end = m.end()
                out.append(s)
    return out + [s for s in stack if s]


def _python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_scan(text)
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(line: int, column: int) -> int:
        row = lines[line - 1]
        return starts[line - 1] + (column if row.isascii() else len(row.encode()[:column].decode("utf-8", "ignore")))

    out = Parsed()
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            at = place(node.lineno, node.col_offset)
            out.symbols.append(Symbol(node.name, "class" if isinstance(node, ast.ClassDef) else "function", at, place(node.end_lineno, node.end_col_offset), True, at))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else last_identifier(ast.get_source_segment(text, f) or "")
            if name:
                out.references.append(Reference(name, "call", place(node.lineno, node.col_offset)))
        elif isinstance(node, ast.Import):
            out.imports.append((node.names[0].name, "import", place(node.lineno, node.col_offset)))
        elif isinstance(node, ast.ImportFrom):
            out.imports.append(("." * node.level + (node.module or ""), "from", place(node.lineno, node.col_offset)))
    return out


def _python_scan(text: str) -> Parsed:
    """By indentation, for text that the parser refuses."""
    code, out = blank(text, "python"), Parsed()
    heads = list(re.finditer(rf"(?m)^(?P<i>[ \t]*)(?:async\s+)?(?P<k>def|class)\s+(?P<n>{NAME})", code))
    for m in heads:
        width, end = len(m["i"].expandtabs()), len(code)
        for line in re.finditer(r"\n(?P<i>[ \t]*)(?=[^\s#])", code[m.end() :]):
            if len(line["i"].expandtabs()) <= width:
                end = m.end() + line.start()
                break
        end = len(code[:end].rstrip())
        out.symbols.append(Symbol(m["n"], "class" if m["k"] == "class" else "function", m.start() + len(m["i"]), end, True, m.start("n")))
    _calls(code, {s.name_at for s in out.symbols}, out, "python")
    for m in re.finditer(r"(?m)^\s*(?:import\s+(?P<a>[\w.]+)|from\s+(?P<b>[.\w]+)\s+import)", code):
        out.imports.append((m["a"] or m["b"], "import" if m["a"] else "from", m.start() + len(m[0]) - len(m[0].lstrip())))
    return out


_CHAIN = re.compile(rf"(?<![\w$@#])(?P<new>new\s+)?(?P<chain>\$?{NAME}(?:\s*(?:\?\.|\.|::|->|\?->|\\)\s*\$?{NAME})*)(?P<turbo>::<[^()]*>|\s*<[\w\s,.:?<>\[\]*&]+>(?=\())?(?P<bang>!)?\s*(?P<open>[(\[{{]?)")
_AFTER = re.compile(rf"(?<=[)\]}}])\s*(?:\?\.|\.|::|->|\?->)\s*(?P<n>{NAME})\s*(?:::<[^()]*>)?\s*\(")


def _calls(code: str, declared: set[int], out: Parsed, family: str) -> None:
    news = family in ("java", "csharp", "php", "c")
    for m in _CHAIN.finditer(code):
        name = last_identifier(m["chain"])
        end = m.end("chain")
        if m["new"]:
            if family != "javascript" and news:
                out.references.append(Reference(name, "new", m.start()))
            continue
        if family == "rust" and m["bang"] and m["open"]:
            out.references.append(Reference(name, "macro", m.start()))
            continue
        if m["open"] != "(" or end - len(name) in declared or m.start("chain") in declared:
            continue
        if name in _KEYWORDS and m["chain"] == name:
            continue
        if m["chain"].startswith("$") and m["chain"][1:] == name and family == "php":
            continue
        out.references.append(Reference(name, "call", m.start()))
    for m in _AFTER.finditer(code):
        line = code.rfind("\n", 0, m.start()) + 1
        start = line + len(code[line : m.start()]) - len(code[line : m.start()].lstrip())
        out.references.append(Reference(m["n"], "call", start))


def _ruby_calls(code: str, declared: set[int], out: Parsed) -> None:
    for m in re.finditer(rf"(?<![\w$@:.])(?P<chain>@{{0,2}}{NAME}[?!]?(?:\s*(?:&?\.|::)\s*{NAME}[?!]?)*)(?P<open>\(|[ \t]+(?=[\w\"':@\[{{&*-])(?![-*&]\s)|)", code):
        chain, name = m["chain"], last_identifier(m["chain"].rstrip("?!"))
        simple = not re.search(r"\.|::", chain)
        if m.start() in declared or m.end("chain") - len(name) in declared or (simple and (name in _KEYWORDS or name in ("end", "self", "nil", "true", "false", "then", "super", "attr_accessor"))):
            continue
        line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
        if re.search(r"\b(?:def|class|module)\s+$", line) or re.match(r"\s*(?:def|class|module)\b[^;]*$", line):
            continue
        if simple and m["open"] != "(" and (line.strip() or not m["open"] or re.match(r"(?:and|or|if|unless|do|while|until|in|then)\b", code[m.end() :])):
            continue
        if not simple and chain[0].isupper() and re.search(rf"::\s*{name}$", chain) and m["open"] != "(":
            continue
        out.references.append(Reference(name, "call", m.start()))


def _imports(code: str, text: str, family: str, out: Parsed) -> None:
    def add(pattern: str, kind: str, flags: int = re.M) -> None:
        for m in re.finditer(pattern, text, flags):
            lead = len(m[0]) - len(m[0].lstrip())
            if code[m.start() + lead] != " " or text[m.start() + lead] == " ":
                source = m["s"].strip().strip("\"'`<>").strip()
                if source:
                    out.imports.append((source, kind, m.start() + lead))

    if family == "javascript":
        add(r"^[ \t]*import\s+(?:[^'\"();]*?\sfrom\s*)?(?P<s>'[^'\n]*'|\"[^\"\n]*\")", "import")
        add(r"(?<![\w.$])require\s*\(\s*(?P<s>'[^'\n]*'|\"[^\"\n]*\")", "require")
        add(r"(?<![\w.$])import\s*\(\s*(?P<s>'[^'\n]*'|\"[^\"\n]*\")", "import")
    elif family == "go":
        add(r"^[ \t]*import\s+(?:[\w.]+\s+)?(?P<s>\"[^\"\n]*\"|`[^`\n]*`)", "import")
        for m in re.finditer(r"(?m)^[ \t]*import\s*\((?P<b>[^)]*)\)", text):
            for x in re.finditer(r"(?:[\w.]+\s+)?[\"`](?P<s>[^\"`\n]+)[\"`]", m["b"]):
                out.imports.append((x["s"], "import", m.start("b") + x.start()))
    elif family == "rust":
        add(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<s>[^;]+);", "use")
    elif family == "java":
        add(r"^[ \t]*import\s+(?:static\s+)?(?P<s>[\w.*]+)\s*;", "import")
    elif family == "c":
        add(r"^[ \t]*#[ \t]*include[ \t]*(?P<s>\"[^\"\n]*\"|<[^>\n]*>)", "include")
    elif family == "csharp":
        add(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<s>[A-Za-z_][\w.]*)\s*;", "using")
    elif family == "ruby":
        add(r"^[ \t]*(?:require|require_relative|load)\b\s*\(?\s*(?P<s>'[^'\n]*'|\"[^\"\n]*\")", "require")
    elif family == "php":
        add(r"^[ \t]*use\s+(?:function\s+|const\s+)?(?P<s>[A-Za-z_\\][^;({]*);", "use")


_DECLARE = {
    "javascript": _js, "go": _go, "rust": _rust, "ruby": _ruby, "php": _php,
    "java": lambda c, t, p: _typed(c, t, p, False), "csharp": lambda c, t, p: _typed(c, t, p, True),
}


def parse(text: str, variant: str) -> Parsed:
    family = _FAMILY.get(variant, variant)
    if family == "python":
        out = _python(text)
    else:
        code = blank(text, family)
        pairs = brackets(code)
        out = Parsed()
        out.symbols = _c(code, text, pairs, variant == "cpp") if family == "c" else _DECLARE[family](code, text, pairs)
        declared = {s.name_at for s in out.symbols if s.name_at >= 0}
        if family == "ruby":
            _ruby_calls(code, declared, out)
        else:
            calls = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), code) if family == "c" else code
            calls = re.sub(r"(?m)^[ \t]*(?:pub\s+)?use\s[^;]*;", lambda m: re.sub(r"[^\n]", " ", m[0]), calls) if family in ("rust", "php") else calls
            _calls(calls, declared, out, family)
        if variant in ("tsx", "javascript"):
            for m in re.finditer(rf"(?<![\w$)\]])<(?P<n>{NAME}(?:\.{NAME})*)(?=[\s/>])", code):
                name = last_identifier(m["n"])
                if name[0].isupper() or name[0] == "_":
                    out.references.append(Reference(name, "jsx", m.start()))
        _imports(code, text, family, out)
    skip = NOT_CALLS.get(family, set())
    out.references = [r for r in out.references if r.name and r.name not in skip]
    return out


def signature(text: str) -> str:
    """The first line, trimmed; at most 180 bytes, cut between characters, and then three dots."""
    line = text.split("\n", 1)[0].strip()
    data = line.encode()
    return line if len(data) <= 180 else data[:180].decode("utf-8", "ignore") + "..."


def rows(path: str, text: str, variant: str) -> list[dict]:
    """All rows of one file: symbols with their qualified names, references with the symbol around them, imports."""
    parsed = parse(text, variant)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)
    base = dict.fromkeys(["qualified_name", "end_line", "signature", "exported", "column", "context", "from_qualified_name"])
    base |= {"path": path}
    symbols = sorted(parsed.symbols, key=lambda s: (s.start, -s.end))
    out, scopes = [], []
    for i, s in enumerate(symbols):
        while scopes and s.start >= scopes[-1][0].end:
            scopes.pop()
        qualified = s.qualified or ".".join([*([scopes[-1][1]] if scopes else []), s.name])
        scopes.append((s, qualified))
        s.qualified = qualified
        out.append(base | {"rec": "symbol", "ordinal": i, "name": s.name, "qualified_name": qualified, "kind": s.kind, "start_line": line_of(s.start), "end_line": line_of(max(s.start, s.end - 1)), "signature": signature(text[s.start : s.end]), "exported": s.exported})
    marks, scopes, at = [], [], 0
    for i, r in enumerate(sorted(parsed.references, key=lambda r: r.at)):
        while at < len(symbols) and symbols[at].start <= r.at:
            while scopes and symbols[at].start >= scopes[-1].end:
                scopes.pop()
            scopes.append(symbols[at])
            at += 1
        while scopes and r.at >= scopes[-1].end:
            scopes.pop()
        line = line_of(r.at)
        begin = starts[line - 1]
        whole = text[begin : starts[line] - 1] if line < len(starts) else text[begin:]
        marks.append(base | {"rec": "ref", "ordinal": i, "name": r.name, "kind": r.kind, "start_line": line, "column": len(text[begin : r.at].encode()) + 1, "context": whole.strip(), "from_qualified_name": scopes[-1].qualified if scopes else None})
    found = [base | {"rec": "import", "ordinal": i, "name": source, "kind": kind, "start_line": line_of(at)} for i, (source, kind, at) in enumerate(sorted(parsed.imports, key=lambda x: x[2])) if source]
    return out + marks + found


_COLUMNS = [c.split()[0] for c in EXTRACTED.split(", ")]


def extract(files: DataFrame) -> DataFrame:
    """`files`: path, content.  Rows of EXTRACTED; a file that fails gives one row of rec `warning`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[dict] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += rows(path, content, variant_of_path(path))
                except Exception as e:  # noqa: BLE001  one bad file must not end the run
                    out.append({"path": path, "rec": "warning", "ordinal": 0, "context": f"parse failed: {e}"})
            table = pd.DataFrame(out, columns=_COLUMNS)
            for c in ("ordinal", "start_line", "end_line", "column"):
                table[c] = table[c].astype("Int32")
            yield table

    return files.select("path", "content").mapInPandas(run, EXTRACTED)
