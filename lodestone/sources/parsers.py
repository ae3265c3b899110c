"""Parsers of source files to facts: symbols, calls, imports and decorators, one file to many rows.

Python files are parsed by the standard library's ``ast``; the other languages are scanned with strings and comments blanked
out, so that braces alone give the nesting. A file that can't be parsed gives one ``error`` row and never fails the job."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "fact string, file_path string, id string, name string, qualified_name string, kind string, start_line int, end_line int, base_names array<string>, parent_id string"
EXTENSIONS = {".py": "python", ".pyi": "python", ".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".c": "cpp", ".h": "cpp", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp"}
_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]{1,9})\'', re.S)
_GO_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)
_JS_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_WORDS = set("if for while switch catch return function else do try new throw typeof await synchronized sizeof super assert yield case default".split())
_OWN_WORDS = {"go": {"func", "go", "defer", "select", "range"}, "rust": {"match", "loop", "fn"}, "kotlin": {"when", "fun"}, "csharp": {"using", "lock", "nameof"}}

_TYPES = {
    "ts": re.compile(r"\b(class|interface)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^{]*?>)?\s*(?:extends\s+(?P<bases>[\w$., <>]+?))?\s*(?:implements\s+(?P<more>[\w$., <>]+?))?\s*\{"),
    "java": re.compile(r"\b(class|interface|enum|record)\s+(?P<name>\w+)\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?:extends\s+(?P<bases>[\w., <>]+?))?\s*(?:implements\s+(?P<more>[\w., <>]+?))?\s*\{"),
    "csharp": re.compile(r"\b(class|interface|struct|record|enum)\s+(?P<name>\w+)\s*(?:<[^{]*?>)?\s*(?::\s*(?P<bases>[\w., <>]+?))?(?P<more>)\s*\{"),
    "kotlin": re.compile(r"\b(class|interface|object)\s+(?P<name>\w+)\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?\s*(?::\s*(?P<bases>[\w., <>()]+?))?(?P<more>)\s*\{"),
    "cpp": re.compile(r"\b(class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[\w:, <>]+?))?(?P<more>)\s*\{"),
    "go": re.compile(r"\btype\s+(?P<name>\w+)\s+(struct|interface)\b(?P<bases>)(?P<more>)\s*\{"),
    "rust": re.compile(r"\b(struct|enum|trait)\s+(?P<name>\w+)(?:<[^{;]*?>)?\s*(?::\s*(?P<bases>[\w:+ ]+?))?(?P<more>)\s*(?:where[^{;]*)?[{;(]"),
}
_FUNCS = {
    "ts": re.compile(r"(?P<fn>\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\()|(?P<arrow>\b(?:const|let|var)\s+(?P<aname>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=]+)?=>)|(?P<m>^[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?(?P<mname>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\([^;{}]*?\)\s*(?::[^;{}=]+)?[{;])", re.M),
    "java": re.compile(r"^[ \t]*+(?:[\w.<>\[\],?]++[ \t]++)*+(?P<name>\w++)[ \t]*+\([^;{}()]*+\)\s*+(?:throws\s++[\w.,]++(?:[ \t]++[\w.,]++)*+\s*+)?[{;]", re.M),
    "csharp": re.compile(r"^[ \t]*+(?:[\w.<>\[\],?]++[ \t]++)*+(?P<name>\w++)[ \t]*+\([^;{}()]*+\)\s*+(?:where[^{;]*+)?(?:[{;]|=>)", re.M),
    "kotlin": re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>\w+)\s*\("),
    "cpp": re.compile(r"^[ \t]*+(?:[\w:<>*&,~]++[ \t]++)++[*&]*+(?P<name>[\w:~]++)[ \t]*+\([^;{}()]*+\)\s*+(?:const\s*+)?(?:noexcept\s*+)?\{", re.M),
    "go": re.compile(r"^func\s+(?:\((?:\w+\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\)\s*)?(?P<name>\w+)\s*[\[(]", re.M),
    "rust": re.compile(r"\bfn\s+(?P<name>\w+)"),
}
_IMPL = re.compile(r"\bimpl\b\s*(?:<[^{]*?>)?\s*(?:[\w:<>, ]+?\s+for\s+)?(?P<name>\w+)[^{;]*\{")
_IMPORTS = {
    "ts": re.compile(r"^\s*import\s+(?:type\s+)?(?:([\w$*{},\s]+?)\s+from\s+)?[\"']([^\"']+)[\"']", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?()([\w.*]+)\s*;", re.M), "csharp": re.compile(r"^\s*using\s+(?:static\s+)?()([\w.]+)\s*;", re.M),
    "kotlin": re.compile(r"^\s*import\s+()([\w.*]+)", re.M), "cpp": re.compile(r"^\s*#\s*include\s+()[\"<]([^\">]+)[\">]", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?()\"([\w./-]+)\"\s*$", re.M), "rust": re.compile(r"^\s*(?:pub\s+)?use\s+()([\w:]+)", re.M),
}


def blanked(lang: str, text: str) -> str:
    """A text of the same length and lines whose strings and comments are spaces."""
    pattern = _JS_BLANK if lang == "ts" else _GO_BLANK if lang == "go" else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _names(bases: str | None) -> list[str]:
    return [b for b in (re.sub(r"<.*?>|\(.*?\)|\b(?:public|private|virtual)\b", "", x).strip() for x in re.split(r"[,+]", bases or "")) if b]


def parse_python(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []
    tree = ast.parse(text)

    def dotted(n: ast.AST) -> str:
        if isinstance(n, ast.Call):
            n = n.func
        if isinstance(n, ast.Attribute):
            return f"{dotted(n.value)}.{n.attr}" if dotted(n.value) else n.attr
        return n.id if isinstance(n, ast.Name) else ""

    stack: list[tuple[ast.AST, str, str | None, str | None]] = [(tree, "", None, None)]
    while stack:  # no recursion: sources may be nested deeply
        node, prefix, parent, caller = stack.pop()
        for child in ast.iter_child_nodes(node):
            p, par, who = prefix, parent, caller
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                p = f"{prefix}.{child.name}" if prefix else child.name
                par = f"{path}::{p}#{child.lineno}"
                kind = "class" if is_class else "method" if parent and isinstance(node, ast.ClassDef) else "function"
                rows.append(("symbol", path, par, child.name, p, kind, child.lineno, child.end_lineno, [dotted(b) for b in child.bases if dotted(b)] if is_class else [], parent))
                rows += [("decorator", path, par, dotted(x), None, None, x.lineno, x.lineno, None, None) for x in child.decorator_list if dotted(x)]
                who = caller if is_class else par
            elif isinstance(child, ast.Call) and dotted(child.func):
                rows.append(("call", path, caller, dotted(child.func).rsplit(".", 1)[-1], None, None, child.lineno, child.lineno, None, None))
            elif isinstance(child, ast.Import):
                rows += [("import", path, None, a.name, None, None, child.lineno, child.lineno, [], None) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                rows.append(("import", path, None, "." * child.level + (child.module or ""), None, None, child.lineno, child.lineno, [a.name for a in child.names], None))
            stack.append((child, p, par, who))
    return rows


def parse_braces(lang: str, path: str, text: str) -> list[tuple]:
    flat, words = blanked(lang, text), _WORDS | _OWN_WORDS.get(lang, set())
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda pos: bisect_right(ends, pos - 1) + 1 if pos else 1
    close, stack, braces, depths = {}, [], [-1], [0]
    for m in re.finditer(r"[{}]", flat):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
        braces.append(m.start())
        depths.append(depths[-1] + (1 if m.group() == "{" else -1))
    depth = lambda pos: depths[bisect_right(braces, pos - 1) - 1]
    types, rows = [], []
    for m in _TYPES[lang].finditer(flat):
        body = m.end() - 1
        end = close.get(body, len(flat)) if flat[body] == "{" else flat.find(";", body) if flat[body] in ";(" else body
        word = m.group(0)
        kind = "interface" if re.search(r"\b(interface|trait)\b", word) else "class"
        start = flat.rfind("\n", 0, m.start()) + 1
        at = line(start)
        if lang == "java":
            at = _annotated(text, ends, at)
        types.append((body if flat[body] == "{" else m.start(), end, m["name"], kind, at, line(end), _names(m["bases"]) + _names(m["more"])))
    owners = [(a, b, n, f"{path}::{n}#{at}") for a, b, n, _, at, _, _ in types]
    reach: dict = {}
    if lang == "rust":  # a type reaches as far as its implementations
        for m in _IMPL.finditer(flat):
            reach[m["name"]] = max(reach.get(m["name"], 0), line(close.get(m.end() - 1, len(flat))))
    for _, _, n, kind, at, last, bases in types:
        last = max(last, reach.get(n, 0))
        rows.append(("symbol", path, f"{path}::{n}#{at}", n, n, kind, at, last, bases, None))
    if lang == "rust":
        by_name = {n: i for _, _, n, i in owners}
        owners = [o for o in owners] + [(m.end() - 1, close.get(m.end() - 1, len(flat)), m["name"], by_name.get(m["name"])) for m in _IMPL.finditer(flat)]
    functions = []
    for m in _FUNCS[lang].finditer(flat):
        d = m.groupdict()
        name = d.get("name") or d.get("aname") or d.get("mname")
        if not name or name in words:
            continue
        at = m.start("name") if d.get("name") else m.start("aname") if d.get("aname") else m.start("mname")
        inside = [o for o in owners if o[0] < at < o[1]]
        owner = max(inside, key=lambda o: o[0]) if inside else None
        if lang == "go" and d.get("recv"):
            owner = next((o for o in owners if o[2] == d["recv"]), (0, 0, d["recv"], None))
        if (d.get("mname") or lang in ("java", "csharp")) and (owner is None or depth(at) != depth(owner[0] + 1)):
            continue
        opening = flat.find("{", at)
        stop = flat.find(";", at)
        end = close.get(opening, len(flat)) if opening >= 0 and (stop < 0 or opening < stop or lang == "go") else stop if stop >= 0 else len(flat)
        start_line = line(at)
        if lang == "java":
            start_line = _annotated(text, ends, start_line)
        q = f"{owner[2]}.{name}" if owner else name
        functions.append((at, end, f"{path}::{q}#{start_line}"))
        rows.append(("symbol", path, f"{path}::{q}#{start_line}", name, q, "method" if owner else "function", start_line, line(end), [], owner[3] if owner else None))
    declared = {a for a, _, _ in functions}
    functions.sort()
    starts, outer, open_ = [f[0] for f in functions], [], []
    for k, (start, end, _) in enumerate(functions):  # of each function the one around it
        while open_ and functions[open_[-1]][1] < start:
            open_.pop()
        outer.append(open_[-1] if open_ else -1)
        open_.append(k)
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", flat):
        if m.group(1) in words or m.start(1) in declared:
            continue
        k = bisect_right(starts, m.start() - 1) - 1
        while k >= 0 and functions[k][1] < m.start():
            k = outer[k]
        rows.append(("call", path, functions[k][2] if k >= 0 else None, m.group(1), None, None, line(m.start()), line(m.start()), None, None))
    for m in _IMPORTS[lang].finditer(text):
        names = re.findall(r"[\w$]+", m.group(1) or "")
        rows.append(("import", path, None, m.group(2), None, None, line(m.start(2)), line(m.start(2)), names, None))
    return rows


def _annotated(text: str, ends: list[int], at: int) -> int:
    """The line of the first annotation on lines of their own above a line."""
    while at > 1:
        begin = ends[at - 3] + 1 if at > 2 else 0
        if not text[begin : ends[at - 2]].strip().startswith("@"):
            return at
        at -= 1
    return at


def parse_file(path: str, text: str) -> list[tuple]:
    dot = path.rfind(".")
    lang = EXTENSIONS.get(path[dot:].lower()) if dot >= 0 else None
    if lang is None:
        return []
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    try:
        return parse_python(path, text) if lang == "python" else parse_braces(lang, path, text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", path, None, type(e).__name__, None, None, getattr(e, "lineno", None), None, None, None)]


def facts(files: DataFrame) -> DataFrame:
    """The facts of every file of ``file_path, source_bytes``; null sources and other extensions give none."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, b in zip(pdf["file_path"], pdf["source_bytes"], strict=True) if p and b is not None for r in parse_file(p, bytes(b).decode("utf-8", "replace"))]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("file_path", "source_bytes").mapInPandas(run, FACTS)


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the file each means: relative and dotted modules as paths with the usual suffixes, the first that exists."""
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    rel = F.when(F.col("name").startswith("./"), F.concat(folder, F.lit("/"), F.substring("name", 3, 10_000))).when(F.col("name").startswith("../"), F.concat(F.regexp_replace(folder, "/[^/]*$", ""), F.lit("/"), F.substring("name", 4, 10_000))).otherwise(F.concat(F.regexp_replace("file_path", "/.*$", ""), F.lit("/"), F.translate("name", ".", "/")))
    suffixes = ["", ".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ".java", ".rs", "/mod.rs"]
    tries = imports.select("file_path", "name", F.posexplode(F.array(*[F.concat(rel, F.lit(x)) for x in suffixes])).alias("k", "target"))
    hit = tries.join(files.select(F.col("file_path").alias("target")).distinct(), "target", "left_semi").groupBy("file_path", "name").agg(F.min_by("target", "k").alias("resolved"))
    return imports.join(hit, ["file_path", "name"], "left")
