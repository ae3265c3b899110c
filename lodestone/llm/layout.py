"""Canonical formatting of source files, and how far an original layout is from it.

``gaps`` gives the white space of the original and of the canonical form before every token but comments. The canonical form
has one statement or bracket to a line, indents by one unit for each open bracket and has one spacing for each pair of
classes. As formatters do, it takes from the original: the unit of indentation, whether a bracket without statements is
written in one line or over several, and the spacing of operators that formatters space by precedence or type
(``_LOOSE``). Blank lines and comments don't matter.
"""

from __future__ import annotations

import re
from collections import Counter

from . import grammars, lexing

#: Tokens before which, and after which, the spacing follows the original.
_LOOSE = {
    "go": set("* / + - % & | ^ << >> &^ : [ ] {".split()),
    "rust": set("| & * ! ' < > + { }".split()),
    "python": set("** : * =".split()),
    "java": set("< > ? & : { }".split()),
    "javascript": set("< > ? : ! * { } /".split()),
}
_LOOSE["typescript"] = _LOOSE["javascript"] | {"|", "&"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_TIGHT_BEFORE = set(", ; ) ] . ?. :: ++ -- ? : .. ..=".split())
_TIGHT_AFTER = set("( [ . ?. :: ! ~ @ # .. ..= ...".split())
_SIGNS = set("+ - * & ! ~ ** <- ++ -- ...".split())
#: Words that are called or indexed as names are.
_CALLED = set("super this self new constructor fn func record".split())
_CALLED_IN = {("import", "javascript"), ("import", "typescript"), ("pub", "rust")}
_ENDS = {"i", "n", "s", "t", "k", ")", "]", "}", "m", "p", "l", "++", "--", "break", "continue", "return", "pass", "this", "super", "self"}
_FOLLOWS = {"else", "catch", "finally", "from", "as", "in", "of", "instanceof", "is", "satisfies"}


def _is_word(c: str) -> bool:
    return c in ("i", "n", "s", "m", "p", "l", "X", "D") or c[:1].isalpha() or c == "_"


def gaps(language: str, text: str) -> tuple[list[str], list[str], list[str]]:
    """Tokens, their white space in the original and that in the canonical form."""
    get, python = grammars.memo(language).__getitem__, language == "python"
    toks, cls, was, pending, end = [], [], [], "", 0
    for m in lexing.LEXERS[language].finditer(text):
        t, space = m.group(), text[end : m.start()]
        end = m.end()
        c = get(t)
        pending += space
        if not c or c[0] == "#" and python or c[0] in "\n \t" or c == "s" and t[:3] in ('"""', "'''") and python and (not was or "\n" in pending):
            pending += "\n" if c == "s" else t if "\n" in t or not t.strip() else "\n" if t[:1] in "/#" and "\n" in text[end : end + 1] else " "
            continue
        toks.append(t)
        cls.append(c)
        was.append("\n" + pending[pending.rfind("\n") + 1 :].expandtabs(8) if "\n" in pending else pending)
        pending = ""
    return toks, was, _canonical(language, toks, cls, was)


def _blocks(cls: list[str]) -> list[bool]:
    """Of each opening bracket, whether it holds statements."""
    holds, stack = [False] * len(cls), []
    for k, c in enumerate(cls):
        if c in _OPEN:
            stack.append(k)
        elif c in _CLOSE and stack:
            j = stack.pop()
            if holds[j] and stack and cls[stack[-1]] == "{":
                holds[stack[-1]] = True
        elif c == ";" and stack and cls[stack[-1]] == "{":
            holds[stack[-1]] = True
    return holds


def _canonical(language: str, toks: list[str], cls: list[str], was: list[str]) -> list[str]:
    python, loose = language == "python", _LOOSE[language]
    widths = Counter(len(w) - 1 for w in was if len(w) > 1 and w[0] == "\n")
    unit = min((w for w, n in widths.items() if n * 20 >= sum(widths.values())), default=4)
    holds = _blocks(cls)
    out: list[str] = []
    stack: list[tuple[str, bool]] = []  # open brackets, and whether their content goes line by line
    level = 0
    indents = [0]  # of Python: widths of open blocks in the original
    memo: dict[tuple, str] = {}
    before = ""  # class before the previous token
    for k, c in enumerate(cls):
        p = cls[k - 1] if k else ""
        if c in _CLOSE and stack:
            _, broken = stack.pop()
            if broken:
                level -= 1
        else:
            broken = False
        inner = stack[-1] if stack else ("", True)
        line = False
        if k == 0:
            out.append("")
        else:
            broke = was[k][:1] == "\n"
            if c in _CLOSE:
                line = broken and p not in _OPEN
            elif p in _OPEN:
                line = inner[1]
            elif python and not stack:
                line = broke or p == ";"
            elif inner[1] and (p == "," and inner[0] or p == ";" and language == "go"):
                line = broke
            elif inner[1] and p == ";" and inner[0] in ("", "{"):
                line = True
            elif inner[1] and inner[0] in ("", "{"):
                if p == "}":
                    line = (broke or cls[k - 1] == "}" and was[k - 1][:1] == "\n") and c not in _FOLLOWS and (_is_word(c) or c in "@#[(" or c == "}")
                elif broke and (p in _ENDS or p == ":") and (_is_word(c) or c in "@#[(*"):
                    line = c not in _FOLLOWS
            if line and python and not stack:
                width = len(was[k]) - 1 if broke else indents[-1]
                while len(indents) > 1 and width < indents[-1]:
                    indents.pop()
                if width > indents[-1]:
                    indents.append(width)
                level = len(indents) - 1
            if line:
                less = c in ("case", "default") and language == "go"
                body = language != "go" and not python and broke and len(was[k]) - 1 == unit * (level + 1) and inner[0] == "{" and "case" in cls[max(0, k - 400) : k]
                out.append("\n" + " " * (unit * (level - less + body)))
            else:
                sign = p in _SIGNS and not (_is_word(before) or before in _CLOSE)
                if (p in loose or c in loose) and was[k] in ("", " ") and (stack or not python):
                    out.append(was[k])
                else:
                    key = (p, c, sign)
                    gap = memo.get(key)
                    if gap is None:
                        gap = memo[key] = _space(language, p, c, sign)
                    out.append(gap)
        if c in _OPEN:
            nxt = was[k + 1][:1] == "\n" if k + 1 < len(cls) else False
            empty = k + 1 < len(cls) and cls[k + 1] in _CLOSE
            line_by_line = not empty and (nxt or holds[k])
            stack.append((c, line_by_line))
            if line_by_line:
                level += 1
        before = p
    return out


def _space(language: str, p: str, c: str, sign: bool) -> str:
    if c in _TIGHT_BEFORE or p in _TIGHT_AFTER or sign:
        return ""
    if p in _OPEN or c in _CLOSE:
        return " " if (p == "{" or c == "}") and language in ("javascript", "typescript", "rust") and not (p == "{" and c == "}") else ""
    if c == "(":
        return "" if p in ("i", "m", ")", "]", "s", "t", "}", ">", "!") or p in _CALLED or (p, language) in _CALLED_IN else " "
    if c == "[":
        return "" if p in ("i", ")", "]", "s", "t", "}", ">", "p", "#", "!") else " "
    if c == "!" and p == "i":
        return ""
    return " "


def canonical_text(language: str, text: str) -> str:
    toks, _, form = gaps(language, text)
    return "".join(g + t for g, t in zip(form, toks, strict=True))


def deviation(language: str, text: str) -> float:
    """Share of the original's lines of code whose indentation, spacing or line breaks are not those of the canonical form."""
    _, was, form = gaps(language, text)
    lines, differ, bad = 0, False, 0
    for k, (a, b) in enumerate(zip(was, form, strict=True)):
        if k == 0 or a[:1] == "\n":
            bad += differ
            lines += 1
            differ = False
        differ |= k > 0 and a != b
    return (bad + differ) / max(1, lines)


# --- shapes -----------------------------------------------------------------------------------------------------------

_IMPORTS = {"import", "package", "use", "from", "mod"}


def _units(cls: list[str], python: bool) -> list[list[str]]:
    """Statements and blocks of the outermost level."""
    out, start, depth = [], 0, 0
    for k, c in enumerate(cls):
        if c in _OPEN or c == "IN":
            depth += 1
        elif c in _CLOSE or c == "DE":
            depth -= 1
        follows = cls[k + 1] if k + 1 < len(cls) else ""
        if depth <= 0 and (c in (";", "NL", "DE") and follows not in ("IN", "DE") or c == "}" and not python and follows not in _FOLLOWS and follows not in (";", ")", ",", ".", "(", "]")):
            out.append(cls[start : k + 1])
            start = k + 1
    if start < len(cls):
        out.append(cls[start:])
    return out


def _shape(unit: list[str]) -> tuple[str, ...]:
    """The lines of a unit by their classes, a line that repeats the one before left out."""
    out, line = [], []
    for c in unit:
        line.append(c)
        if c in (";", "{", "}", ",", "NL"):
            one = " ".join(line)
            if not out or out[-1] != one:
                out.append(one)
            line = []
    return (*out, " ".join(line))


def repeated_shapes(language: str, cls: list[str]) -> tuple[int, int, int]:
    """Of a file's outermost units, or of those within one that wraps the rest: tokens, tokens in units whose shape three at
    least share, and the number of such units. Imports are left out."""
    python = language == "python"
    units = [u for u in _units([c for c in cls if c and c != "\n"], python) if u[0] not in _IMPORTS]
    largest = max(units, key=len, default=[])
    total = sum(map(len, units))
    if len(largest) * 2 > total:
        cut = largest.index("IN") if python and "IN" in largest else largest.index("{") if not python and "{" in largest else None
        if cut is not None:
            inside = _units(largest[cut + 1 : -1], python)
            if len(inside) >= 3:
                units = inside
    shapes = [_shape(u) for u in units]
    count = Counter(shapes)
    again = [len(u) for u, s in zip(units, shapes, strict=True) if count[s] >= 3]
    return sum(map(len, units)), sum(again), len(again)
