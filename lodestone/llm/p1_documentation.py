"""Functions paired with their documentation (problem 1).

Each file is lexed once and its tokens are exploded into rows: declarations of functions (D) and types (T), braces (B, in Python the
changes of indentation of logical lines), comments that begin a line (C), annotations and attributes on lines of their own (A), and
strings that are the first line of a Python function (S). The rest is windows over the rows of a file:

* a running sum of the braces' deltas is the depth; a function's body is the next pair of its level, so it is delimited without a
  parser, and a method is one only where the pair around it is that of a type (where a file's braces balance),
* comments form islands of neighbouring lines (gaps and islands), which annotations bridge and a declaration ends,
* lag and lead attach an island to the declaration below it, a docstring to the definition above it.

Name, place and end of a function come from these rows; ``symbols`` only gives the id, by file and place. Deliveries are lexed where
they are read; what is shuffled is their rows, once, the texts of comments that can't document left out.

A symbol without a source, or of a kind other than function and method, has no row; repeated symbols and files count once
(files: the latest delivery, by path). Null ids and paths have no row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexing
from .p4_syntax import is_source

ROWS = "file_path string, delivered timestamp, rows struct<code: array<tinyint>, line: array<int>, end_line: array<int>, text: array<string>>"
#: Kind, style and delta of a row by its code; the text of a declaration is its name. Rows travel as arrays of small numbers.
CODES = [("B", None, 1), ("B", None, -1), ("T", None, 0), ("A", None, 0), *(("C", x, 0) for x in ("line", "line_doc", "block", "block_doc")), ("S", "string", 0), *(("D", x, 0) for x in ("plain", "plain_body", "member", "member_body"))]
_CODE = {x: k for k, x in enumerate(CODES)}

_OTHERS = {
    "javascript": lexing._TEMPLATE + "|" + lexing._CSTRING + "|" + lexing._CCHAR,
    "java": r'"""(?:[^\\]|\\.)*?"""|' + lexing._CSTRING + "|" + lexing._CCHAR,
    "go": r"`[^`]*`|" + lexing._CSTRING + "|" + lexing._CCHAR,
    "rust": r'r(?P<h>\#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*+"|' + r"'(?:[^'\\\n]|\\[^\n]+?)'",
}
_OTHERS["typescript"] = _OTHERS["javascript"]
_GROUP = r'\((?:"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|[^()\"']|\((?:[^()]|\([^()]*\))*\))*\)"
_PARAMETERS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+\)"
_NO_NAME = r"(?!(?:if|for|while|switch|catch|return|function|new|throw|else|case|yield|assert|await|typeof|super|do|try)\b)"
_SCRIPT = (
    rf"\bfunction\b\s*\*?\s*(?P<n1>[\w$]+)[^{{}};(]*{_PARAMETERS}(?:\s*:[^{{}};=]+)?|\b(?:const|let|var)\s+(?P<n2>[\w$]+)[^=;\n]*=\s*(?:async\s*)?(?:{_PARAMETERS}|[\w$]+)(?:\s*:[^=;{{}}]+)?\s*=>"
    rf"|^[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)[ \t]+)*[*\#]?{_NO_NAME}(?P<n3>[A-Za-z_$][\w$]*)[ \t]*(?:<[^()\n]*>)?{_PARAMETERS}(?:(?=\s*\{{)|\s*:\s*[^;{{}}=\n]+(?=[;{{\n]))"
)
#: Declarations of functions up to their bodies. Those named ``n3`` are methods, where they stand directly in a type.
_DECLARED = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": rf"^[ \t]*(?:@\w+(?:{_GROUP})?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^()\n]*>[ \t]*)?{_NO_NAME}(?:[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*[ \t]+)?(?P<n3>\w+)[ \t]*{_PARAMETERS}\s*(?:throws[^{{;]*)?(?=[{{;])",
    "go": rf"^func[ \t]+(?:\([^()]*\)[ \t]*)?(?P<n1>\w+)(?:\[[^\]]*\])?[ \t]*{_PARAMETERS}(?:[^{{\n]|(?:interface|struct)[ \t]*\{{[^{{}}]*\}})*?(?=\{{|\n|\Z)",
    "rust": rf"\bfn[ \t]+(?P<n1>\w+)[^{{}};(]*{_PARAMETERS}[^{{}};]*(?=[{{;])",
}
_SCAN = {
    k: re.compile(
        r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<a>^[ \t]*(?:" + (r"\#!?\[(?:\"[^\"\n]*\"|[^\]\"])*\]" if k == "rust" else r"@[\w.$]+(?:" + _GROUP + ")?") + r"[ \t]*)+$)|(?P<d>" + _DECLARED[k]
        + r")|(?P<t>(?<![.\w])(?:class|interface|enum|record|struct|trait|impl)\b(?=[^;(){}=]*\{|\s+\w+\s*\())|(?P<b>[{}])|" + v,
        re.S | re.M,
    )
    for k, v in _OTHERS.items()
}


#: Styles that document a function, by language (fixed values).
STYLES = {"python": ["string"], "java": ["block_doc"], "javascript": ["block_doc"], "typescript": ["block_doc"], "rust": ["line_doc", "block_doc"], "go": ["line", "line_doc", "block", "block_doc"]}


def brace_rows(lang: str, text: str) -> list[tuple]:
    ends = [m.start() for m in re.finditer("\n", text)]
    line_at = lambda pos: bisect_right(ends, pos - 1) + 1 if pos else 1
    rows = []
    for m in _SCAN[lang].finditer(text):
        s, e = m.span()
        if m["b"]:
            line = line_at(s)
            rows.append(("B", line, line, None, 1 if text[s] == "{" else -1, None, None))
        elif m["t"]:
            rows.append(("T", line_at(s), line_at(s), None, 0, None, None))
        elif m["c"]:
            line = line_at(s)
            begin = ends[line - 2] + 1 if line > 1 else 0
            if text[begin:s].strip(" \t"):
                continue
            t = m.group()
            style = "line" if t[1] == "/" else "block"
            if style == "line" and t[:3] == "///" and t[:4] != "////" or style == "block" and t[:3] == "/**" and len(t) > 4:
                style += "_doc"
            rows.append(("C", line, line_at(e), style, 0, t if style in STYLES[lang] else None, None))
        elif m["a"]:
            rows.append(("A", line_at(s), line_at(e), None, 0, None, None))
        elif m["d"]:
            g = m.groupdict()
            which = next(n for n in ("n1", "n2", "n3") if g.get(n))
            body = text[e : e + 200].lstrip()[:1] == "{"
            rows.append(("D", line_at(m.start(which)), line_at(e), ("member" if which == "n3" else "plain") + ("_body" if body else ""), 0, None, m[which]))
    return rows


_DEF = re.compile(r"(?:async[ \t]+)?def\b")


def python_rows(text: str) -> list[tuple]:
    """Definitions, docstrings, and the changes of indentation of the logical lines; what closes is at the line before."""
    rows: list[tuple] = []
    levels, depth, line = [0], 0, 1
    first = name = None  # of the logical line: first token, and what it defines
    start = count = width = 0
    indent, ended, after = 0, 0, None  # indentation of the line to come, end of the last logical line, row of the last definition

    def finish(end: int) -> None:
        nonlocal after, ended
        while width < levels[-1]:
            levels.pop()
            rows.append(("B", ended, ended, None, -1, None, None))
        if width > levels[-1]:
            levels.append(width)
            rows.append(("B", start, start, None, 1, None, None))
            if after is not None:
                rows[after] = (*rows[after][:3], "plain_body", *rows[after][4:])
        if after is not None and count == 1 and first[-1] in "\"'" and first.lstrip("rRuU")[:1] in ("'", '"'):
            rows.append(("S", start, end, "string", 0, first, None))
        after = None
        if name is not None:
            after = len(rows)
            rows.append(("D", start, end, "plain", 0, None, name))
        ended = end

    wants = False
    for t in lexing.tokens("python", text):
        c = t[0]
        if c in " \t\n":
            if "\n" in t:
                if not depth and first is not None:
                    finish(line)
                    first, name, count, wants = None, None, 0, False
                if not depth:
                    indent = len(t[t.rfind("\n") + 1 :].expandtabs(8))
            elif first is None and line == 1:
                indent = len(t.expandtabs(8))
        elif c == "#" and "\n" not in t or t == "\\\n":
            pass
        elif c == "#":
            if not depth and first is not None:
                finish(line)
                first, name, count, wants = None, None, 0, False
            if not depth:
                indent = len(t[t.rfind("\n") + 1 :].expandtabs(8))
        else:
            if first is None:
                first, start, width = t, line, indent
                wants = t == "def"
            elif count == 1 and first == "async" and t == "def":
                wants = True
            elif wants:
                name, wants = t, False
            count += 1
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
        line += t.count("\n")
    if first is not None:
        finish(line)
    rows += [("B", ended, ended, None, -1, None, None)] * (len(levels) - 1)
    return rows


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["code", "line", "end_line", "text"], [pa.int8(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        paths = batch.column("file_path")
        out, offsets = [[] for _ in names], [0]
        for path, source in zip(paths.to_pylist(), batch.column("source_bytes"), strict=True):
            if source.is_valid:
                lang, text = lexing.language_of(path), lexing.decode(source.as_buffer())
                for kind, line, end, style, delta, words, name in python_rows(text) if lang == "python" else brace_rows(lang, text):
                    for column, v in zip(out, (_CODE[kind, style, delta], line, end, name or words), strict=True):
                        column.append(v)
            offsets.append(len(out[0]))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in zip(out, types, strict=True)]
        yield pa.RecordBatch.from_arrays([paths, batch.column("delivered"), pa.StructArray.from_arrays(lists, names)], ["file_path", "delivered", "rows"])


def functions(rows: DataFrame) -> DataFrame:
    """``file_path, lang, name, start_line, end_line, style, documentation`` of every function that the rows declare, the last two null
    where nothing stands above it (in Python: below). All windows follow one exchange by file."""
    w = Window.partitionBy("file_path").orderBy("seq")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_path")
    kind, python = F.col("kind"), F.col("lang") == "python"
    code, stands = kind.isin("B", "D", "T"), kind.isin("A", "C", "D", "S")
    r = rows.withColumn("_depth", F.sum("delta").over(w)).withColumn("_code", F.last(F.when(code, kind), True).over(before))
    r = r.withColumn("_above", F.last(F.when(stands, F.struct("kind", "end_line")), True).over(before))
    r = r.withColumn("_level", F.when(code, F.col("_depth") - F.when(F.col("delta") > 0, 1).otherwise(0)))
    joined = F.when(python, (kind == "S") & (F.col("_above.kind") == "D")).otherwise((F.col("_above.kind") != "D") & (F.col("line") == F.col("_above.end_line") + 1))
    r = r.withColumn("_island", F.sum(F.when(stands & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)).over(w))
    r = r.withColumn("_balanced", (F.sum("delta").over(whole) == 0) & (F.min("_depth").over(whole) >= 0))
    # The next rows of a declaration's level are the pair of its body.
    v = Window.partitionBy("file_path", "_level").orderBy("seq")
    end = F.when(F.col("style").endswith("_body") & (F.lead("kind", 1).over(v) == "B"), F.coalesce(F.lead("line", 2).over(v), F.col("end_line"))).otherwise(F.col("end_line"))
    r = r.withColumn("_end", end)
    # The last pair opened around a row; of a method it must be that of a type.
    r = r.withColumn("_inner", F.when(F.col("delta") > 0, F.col("_level") + 1).when(kind == "D", F.col("_level")))
    u = Window.partitionBy("file_path", "_inner").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_in_type", F.last(F.when(F.col("delta") > 0, F.col("_code") == "T"), True).over(u))
    declared = (kind == "D") & (~F.col("style").startswith("member") | ~F.col("_balanced") | F.coalesce("_in_type", F.lit(False)))
    first = F.min(F.when((F.col("lang") == "java") & (kind == "A"), F.col("line")))
    islands = r.filter(stands).groupBy("file_path", "lang", "_island").agg(
        F.max(F.when(declared, F.struct("line", "name", "_end"))).alias("_d"), first.alias("_first"),
        F.array_sort(F.collect_list(F.when(kind.isin("C", "S"), F.struct("seq", "style", "text")))).alias("_rows"))
    # The last run of an island: neighbouring line comments of one style, or a single block.
    run = F.aggregate(
        "_rows",
        F.struct(F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("text")),
        lambda acc, x: F.struct(x["style"].alias("style"), F.when((acc["style"] == x["style"]) & x["style"].startswith("line"), F.concat(acc["text"], F.lit("\n"), x["text"])).otherwise(x["text"]).alias("text")),
    )
    out = islands.filter("_d is not null").withColumn("_run", run)
    return out.select("file_path", "lang", "_d.name", F.coalesce("_first", "_d.line").alias("start_line"), F.col("_d._end").alias("end_line"), "_run.style", F.col("_run.text").alias("documentation"))


def description(text: Column) -> Column:
    """The words of a documentation comment: markers, tag lines and markup taken away."""
    t = F.regexp_replace(text, r"""^[rRuU]*(\"\"\"|'''|"|')|(\"\"\"|'''|"|')$""", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(/\*+!?|///?!?|\*+(?!/))|\*+/[ \t]*$", "")
    for pattern in TAG_LINES:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"\{@(code|literal|link|linkplain)\s+([^}]*)\}", "$2")
    t = F.regexp_replace(t, r"\{@\w+[^}]*\}|</?[A-Za-z][^<>]*>|&\w+;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Lines about parameters, returns and references: Java and JavaScript tags, Python field lists and sections with their
#: entries, Rust sections with theirs, and plain "name:" entries. Order matters: sections go before their leftovers.
TAG_LINES = [
    r"(?m)^[ \t]*@\w+.*$",
    r"(?m)^[ \t]*:(param|type|return|returns|rtype|raises|raise|keyword|arg|var|ivar|cvar|yield|yields|meta|see)\b[^:\n]*:.*$",
    r"(?m)^[ \t]*#*[ \t]*(Args|Arguments|Parameters|Params|Returns|Return|Yields|Raises|Throws|Errors|Panics|Safety|See also|References|Attributes)[ \t]*:?[ \t]*$(\n[ \t]*[-=~]{3,}[ \t]*$)?",
    r"(?m)^[ \t]*([*+-][ \t]+)?`?\*{0,2}[A-Za-z_]\w*`?([ \t]*\([^)\n]*\))?[ \t]*:([ \t]+.*)?$",
    r"(?m)^[ \t]*[*+-][ \t]+`[^`\n]+`([ \t]*[-:].*)?$",
    r"(?m)^[ \t]*[-=~]{3,}[ \t]*$",
]

#: Articles of the four languages (fixed values).
ARTICLES = ["a", "an", "the", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las", "una"]


def parts(words: Column) -> Column:
    """Lower-cased parts of words, split at underscores, digits and changes of case, inflection taken off."""
    t = F.regexp_replace(words, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W\d]+", " ")
    return F.transform(F.filter(F.split(F.lower(t), " "), lambda x: x != ""), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<=\w{3})(ing|ies|ied|es|ed|s|e|y)$", ""), r"(?<=\w{2})s+$", ""))


def is_trivial(description: Column, name: Column) -> Column:
    words = F.regexp_count(description, F.lit(r"[\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_'’-]*"))
    plain = F.regexp_replace(description, r"[^\p{L}\p{N}_]+", " ")
    beyond = F.array_except(parts(plain), F.concat(parts(name), F.array(*[F.lit(x) for x in ARTICLES])))
    return (words < 4) | (F.size(beyond) == 0)


def lexed(files: DataFrame) -> DataFrame:
    """The token rows of every source file, of its latest delivery: ``file_path, lang, seq, kind, line, end_line, style, delta, text, name``.

    They are exchanged once, by file, so the windows over a file need no other exchange."""
    time = F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("delivered")
    tokens = files.filter(is_source(F.col("file_path"))).select("file_path", "source_bytes", time).mapInArrow(token_rows, ROWS)
    latest = tokens.groupBy("file_path").agg(F.max_by("rows", "delivered").alias("r"))
    rows = latest.select("file_path", F.posexplode(F.arrays_zip("r.code", "r.line", "r.end_line", "r.text")).alias("seq", "r"))
    of_code = lambda k, kind: F.element_at(F.array(*[F.lit(x[k]).cast(kind) for x in CODES]), F.col("r.code").cast("int") + 1)
    extension = F.lower(F.regexp_extract("file_path", r"(\.[^.]*)$", 1))
    lang = F.lit(None).cast("string")
    for e, name in lexing.EXTENSIONS.items():
        lang = F.when(extension == e, name).otherwise(lang)
    declared = of_code(0, "string") == "D"
    return rows.select("file_path", lang.alias("lang"), "seq", of_code(0, "string").alias("kind"), "r.line", "r.end_line", of_code(1, "string").alias("style"), of_code(2, "int").alias("delta"),
                       F.when(~declared, F.col("r.text")).alias("text"), F.when(declared, F.col("r.text")).alias("name"))


def documented(rows: DataFrame) -> DataFrame:
    """Functions whose documentation is not trivial: ``file_path, name, start_line, end_line, description``."""
    fits = F.lit(False)
    for lang, styles in STYLES.items():
        fits = fits | ((F.col("lang") == lang) & F.col("style").isin(styles))
    out = functions(rows).filter(fits).withColumn("description", description(F.col("documentation")))
    return out.filter(~is_trivial(F.col("description"), F.coalesce("name", F.lit("")))).select("file_path", "name", "start_line", "end_line", "description")


def wanted(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind in ('function', 'method') and id is not null").select("id", "file_path", "start_line")


def found(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return wanted(symbols).join(documented(lexed(files)).select("file_path", "start_line"), ["file_path", "start_line"]).select("id").distinct()


def pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Code and description of every documented function: ``id, name, language, start_line, end_line, code, description``. The code runs
    from its place to the end of its body, both from the rows of its file. Sources are joined once a file, not once a function."""
    doc = wanted(symbols).distinct().join(documented(lexed(files)), ["file_path", "start_line"])
    of_file = doc.groupBy("file_path").agg(F.collect_list(F.struct("id", "name", "start_line", "end_line", "description")).alias("fs"))
    time = F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    latest = files.filter(is_source(F.col("file_path"))).groupBy("file_path").agg(F.max_by(F.struct("source_bytes", "language"), time).alias("_f"))
    lines = F.split(F.regexp_replace(F.make_valid_utf8(F.col("_f.source_bytes").cast("string")), "^\ufeff", ""), "\r\n|\r|\n").alias("lines")
    j = of_file.join(latest, "file_path").select("fs", F.col("_f.language").alias("language"), lines)
    code = lambda f: F.array_join(F.slice("lines", F.greatest(f["start_line"], F.lit(1)), F.greatest(f["end_line"] - f["start_line"] + 1, F.lit(0))), "\n")
    cut = j.select("language", F.explode(F.transform("fs", lambda f: F.struct(f.alias("f"), code(f).alias("code")))).alias("x"))
    return cut.select("x.f.id", "x.f.name", "language", "x.f.start_line", "x.f.end_line", "x.code", "x.f.description").dropDuplicates(["id"])
