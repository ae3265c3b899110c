"""Lexers of the six source languages, shared by the operators on source code.

Each lexer is one alternation that covers every character of a text, so ``findall`` yields its tokens at regex speed;
``classes`` maps token texts to grammar classes through a memo dictionary.
"""

from __future__ import annotations

import re

#: File extension -> language (fixed values).
EXTENSIONS = {".py": "python", ".ts": "typescript", ".js": "javascript", ".java": "java", ".go": "go", ".rs": "rust"}

_CSTRING = r'"(?:[^"\\\n]|\\.)*+"'
_CCHAR = r"'(?:[^'\\\n]|\\.)*+'"
_BLOCK = r"/\*(?:.*?\*/|.*)"
_IN_COMMENT = r"[^*/]|\*(?!/)|/(?!\*)"
#: Block comments of Rust nest; three levels are told.
_NESTED = rf"/\*(?:{_IN_COMMENT}|/\*(?:{_IN_COMMENT}|/\*(?:{_IN_COMMENT})*+\*/)*+\*/)*+(?:\*/|.*)"
_LINE = r"//[^\n]*"
_WORD = r"[^\W\d]\w*"
_NUMBER = r"0[xXbBoO][\da-fA-F_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?\w*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*\})*+`)*+\})*+`"

_PATTERNS = {
    "python": r'(?:[fFtT][rR]?|[rR][fFtT])(?:"(?!"")(?:[^"\\{\n]|\\.|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})+\})*+"|' + r"'(?!'')(?:[^'\\{\n]|\\.|\{\{|\{(?:[^{}\n]|\{[^{}\n]*\})+\})*+')|"
    r'[rRbBuUfFtT]{0,2}(?:"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?'''|" + _CSTRING + "|" + _CCHAR + r")"
    r"|(?:[ \t]*(?:\#[^\n]*)?\n)+[ \t]*|\#[^\n]*|" + _WORD + "|" + _NUMBER
    + r"|\.\.\.|:=|->|\*\*=|//=|>>=|<<=|[-+*/%&|^@=!<>]=|\*\*|//|<<|>>|\\\n|[^ \t\f]",
    "javascript": _LINE + "|" + _BLOCK + "|" + _CSTRING + "|" + _CCHAR + "|" + _TEMPLATE + r"|[$@#]?(?:[^\W\d]|\$)[\w$]*|" + _NUMBER + "n?"
    + r"|\n|\.\.\.|=>|\?\.(?!\d)|\?\?=|\|\|=|&&=|\*\*=|<<=|===|!==|==|!=|<=|\+\+|--|&&|\|\||\?\?|\*\*|<<|[-+*/%&|^]=|[^ \t\f]",
    "java": _LINE + "|" + _BLOCK + r'|"""(?:[^\\]|\\.)*?"""|' + _CSTRING + "|" + _CCHAR + r"|(?:[^\W\d]|\$)[\w$]*|" + _NUMBER
    + r"|\.\.\.|->|::|==|!=|<=|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^]=|[^ \t\f\n]",
    "go": _LINE + "|" + _BLOCK + "|" + _CSTRING + "|" + _CCHAR + r"|`[^`]*`|" + _WORD + "|" + _NUMBER + "i?"
    + r"|\n|\.\.\.|:=|<-|==|!=|<=|>=|\+\+|--|&&|\|\||&\^=|<<=|>>=|&\^|<<|>>|[-+*/%&|^]=|[^ \t\f]",
    "rust": _LINE + "|" + _NESTED + r'|b?r(\#*)".*?"\1|[bc]?"(?:[^"\\]|\\.)*+"|' + r"b?'(?:[^'\\\n]|\\[^\n]+?)'|'[^\W\d]\w*|" + r"r\#\w+|" + _WORD
    + r"|0[xbo][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?\d+)?\w*" + r"|\.\.=|\.\.\.|\.\.|=>|->|::|==|!=|<=|&&|\|\||[-+*/%&|^]=|[^ \t\f\n]",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
# findall gives the first group where there is one, so the only group is the whole token.
LEXERS = {k: re.compile("(" + v.replace(r"(\#*)", r"(?P<h>\#*)").replace(r"\1", "(?P=h)") + ")", re.S) for k, v in _PATTERNS.items()}


def decode(source: bytes | None) -> str | None:
    """Text of a file: byte order mark dropped, line ends made uniform, undecodable bytes replaced; None for None."""
    if source is None:
        return None
    return bytes(source).decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def language_of(path: str | None) -> str | None:
    """Language that the last extension of a path names, whatever its case; None for others."""
    dot = (path or "").rfind(".")
    return EXTENSIONS.get(path[dot:].lower()) if dot >= 0 else None


def tokens(language: str, text: str) -> list[str]:
    """All tokens of a text, comments and (where the lexer keeps them) line ends included, in order."""
    found = LEXERS[language].findall(text)
    return [t[0] for t in found] if found and isinstance(found[0], tuple) else found


#: Reserved words that the grammars treat as words of their own (fixed values).
_KEYWORDS = {
    "python": "and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try type while with yield",
    "javascript": "as from async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new of return super switch this throw try typeof var let void while yield",
    "java": "assert break case catch class continue default do else enum extends finally for if implements import instanceof interface new package permits record return super switch synchronized this throw throws try while yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type union unsafe use where while",
}
_KEYWORDS["typescript"] = _KEYWORDS["javascript"] + " interface type enum implements namespace declare satisfies is keyof infer module asserts unique"
_MODIFIERS = {
    "javascript": "static get set",
    "typescript": "static get set public private protected readonly abstract override",
    "java": "public private protected static final abstract native transient volatile strictfp sealed",
}
_PRIMITIVES = {"java": "int long short byte char boolean float double void"}
#: Operator tokens by class: A assigns, b only joins two operands, u only precedes one; others are classes of their own.
_OPERATORS = {
    "python": {"A": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "b": "// % == != <= >= < > & | ^ << >>", "u": "~"},
    "javascript": {"A": "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", "b": "=== !== == != <= && || ?? / % ^ ** <<", "u": "~"},
    "typescript": {"A": "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", "b": "=== !== == != <= && || ?? / % ^ ** <<", "u": "~"},
    "java": {"A": "+= -= *= /= %= <<= &= |= ^=", "b": "== != <= && || / % ^ | <<", "u": "! ~"},
    "go": {"A": "+= -= *= /= %= <<= >>= &= |= ^= &^=", "b": "== != <= >= < > && || / % | << >> &^", "u": "!"},
    "rust": {"A": "+= -= *= /= %= &= |= ^=", "b": "== != <= / % ^", "u": ""},
}
_FSTRING = re.compile(r"(?:[^{}]|\{\{|\}\}|\{[^{}]+(?:\{[^{}]*\}[^{}]*)*\})*+", re.S)
#: Number literals by language; a token that begins like one and isn't is invalid.
_DIGITS = r"\d(?:_?\d)*"
_FLOAT = rf"(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_RADIX = r"0[xX]_?[\da-fA-F](?:_?[\da-fA-F])*|0[oO]_?[0-7](?:_?[0-7])*|0[bB]_?[01](?:_?[01])*"
_NUMBERS = {
    "python": rf"{_RADIX}|0(?:_?0)*|[1-9](?:_?\d)*|{_DIGITS}[jJ]|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}[eE][+-]?{_DIGITS}[jJ]?",
    "javascript": rf"(?:{_RADIX}|{_DIGITS})n?|{_FLOAT}",
    "java": rf"(?:0[xX][\da-fA-F](?:_*[\da-fA-F])*|0[bB][01](?:_*[01])*|\d(?:_*\d)*)[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdD]?|0[xX][\da-fA-F_.]+[pP][+-]?\d+[fFdD]?",
    "go": rf"(?:{_RADIX}|{_FLOAT}|0[xX][\da-fA-F_.]*[pP][+-]?\d+)i?",
    "rust": r"(?:0x_*[\da-fA-F][\da-fA-F_]*|0o_*[0-7][0-7_]*|0b_*[01][01_]*|\d[\d_]*(?:\.\d[\d_]*|\.)?(?:[eE][+-]?_*\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?",
}
_NUMBERS = {k: re.compile(v) for k, v in (_NUMBERS | {"typescript": _NUMBERS["javascript"]}).items()}
_JAVA_CHAR = re.compile(r"'(?:[^'\\]|\\(?:[btnfrs0\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))'")
_PUNCTUATION = set("()[]{}<>,;:.?=+-*&|!@#") | {"...", ":=", "->", "=>", "?.", "++", "--", "<-", "::", "..", "..=", "||", "&&", "**", "_", "\n"}


class Classes(dict):
    """Memo from a token's text to its grammar class; ``""`` is a token without meaning to the grammar, ``X`` an invalid one.

    Strings and comments are classed but not kept, so the memo grows with the vocabulary of names only, and it is emptied
    when it passes ``most`` entries.
    """

    def __init__(self, language: str, most: int = 200_000):
        super().__init__()
        self.language, self.most = language, most
        self.fixed = {w: w for w in _KEYWORDS[language].split()}
        self.fixed |= {w: "m" for w in _MODIFIERS.get(language, "").split()} | {w: "p" for w in _PRIMITIVES.get(language, "").split()}
        for c, ops in _OPERATORS[language].items():
            self.fixed |= {op: c for op in ops.split()}
        if language == "python":
            self.fixed |= dict.fromkeys(("None", "True", "False"), "k") | {"/": "/"}
        if language == "go":
            self.fixed["~"] = "~"
        if language == "rust":
            self.fixed |= {c: c for c in "_$~"}

    def __missing__(self, token: str) -> str:
        c = self.classed(token)
        if len(token) <= 40 and c not in ("s", "t", ""):
            if len(self) >= self.most:
                self.clear()
            self[token] = c
        return c

    def classed(self, t: str) -> str:
        if t in self.fixed:
            return self.fixed[t]
        first, lang = t[0], self.language
        if lang == "python":
            if first == "#" and "\n" not in t or t == "\\\n":
                return ""
            if first == "#":
                return t
            if first in " \t\n":
                return t
            k = next((k for k in range(min(3, len(t))) if t[k] in "\"'"), -1)
            if k >= 0 and (k == 0 or t[:k].isalpha()):
                if len(t) - k < 2 or t[k] != t[-1]:
                    return "X"
                if "f" in t[:k].lower():
                    q = 3 if t[k : k + 3] in ('"""', "'''") and len(t) - k >= 6 else 1
                    return "s" if _FSTRING.fullmatch(t, k + q, len(t) - q) else "X"
                return "s"
        elif first == "/" and t[:2] == "//":
            return ""
        elif first == "/" and t[:2] == "/*":
            return "" if len(t) > 3 and t.endswith("*/") else "X"
        elif first in "\"'`":
            if lang == "rust" and first == "'" and t[-1] != "'" and len(t) > 1:
                return "l"
            if lang == "java" and first == "'" and len(t) < 12 and not _JAVA_CHAR.fullmatch(t) and not (len(t) == 4 and ord(t[1]) > 0xD7FF):
                return "X"
            return ("t" if first == "`" and lang != "go" else "s") if len(t) > 1 and t[-1] == first else "X"
        elif lang == "rust" and t[-1] in "\"#'" and first in "brc" and len(t) > 2:
            return "s"
        if first == "\n":
            return "\n"
        if first.isdigit() or (first == "." and len(t) > 1 and t[1].isdigit()):
            return "n" if _NUMBERS[lang].fullmatch(t) else "X"
        if first == "_" or first.isalpha() or (first == "$" and lang in ("javascript", "typescript", "java")):
            return "i"
        if len(t) > 1 and first in "@#" and lang in ("javascript", "typescript"):
            return "D" if first == "@" else "i"
        return t if t in _PUNCTUATION else "X"
