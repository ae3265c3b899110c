"""Generated, minified or vendored source files (problem 2).

Each file is lexed and set against its canonical formatting, one statement or bracket to a line; how far the original layout
is from it, and what its tokens are, tells most of it:

* extreme expansion, many canonical lines out of one original line, marks minified and bundled script,
* perfect uniformity marks generated code: a valid file whose lines hardly differ from the canonical text (``layout``) and
  whose units, imports aside, repeat a few shapes of tokens; also a file whose functions are all of one numbered series,
* dominance of literals, with hardly a name among the tokens, marks data written as code.

Reasons that a file was offered for add to that: one that says itself that the file is generated, minified, vendored or data, and
subjects of one or two letters, as minified script has, where the layout expands a little too. The rest is told by the path (directories of tools and of third parties, suffixes of tool output) and by a notice at the
head of the file that says of this very file that a tool wrote it or that it comes from elsewhere. A notice of the
repository's own team, and comments that merely mention generators, tell nothing.

Null paths, null sources and Markdown never count. A file has one row, whatever the number of its deliveries (the latest
counts) and of the candidates and packages that offer it. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .p4_syntax import is_source

# Directories and suffixes that tools and third-party copies use.
GENERATED_DIRS = "generated __generated__ autogen autogenerated auto-generated generated-sources generated-src generated_src gen-src stubs"
VENDOR_DIRS = "vendor _vendor vendored vendors third_party third-party thirdparty 3rdparty 3rd_party external externals deps node_modules bower_components jspm_packages site-packages pods"
GENERATED_NAME = r"(?i)([._-](gen|generated|g|pb|pb2|pb2_grpc|autogen|designer)\.\w+|_pb2(_grpc)?\.py|\.pb\.\w+)$|Grpc\.java$|^zz_generated"
MINIFIED_NAME = r"(?i)[.-](min|bundle|packed|prod\.min)\.(js|ts)$"

#: Notices that say of their own file that a tool wrote it; each begins a comment line at the head of a file.
TOOL_NOTICE = re.compile(
    r"code generated by\b|@generated\b|<auto-?generated|auto-?generated (by|from|file|code)|(this|the) (file|code|class|module) (is|was|has been) (\w+ )?(generated|produced|created|built|written|emitted)\b"
    r"|(automatically|mechanically) (generated|built|produced|created|written)|machine[- ](written|generated|made|produced)\b|generated (by|from|with|using) |do not (edit|modify|change)\b"
    r"|(automatisch|maschinell) (erzeugt|generiert|erstellt)|(diese datei|dieser code) (wurde|ist) (\w+ )?(erzeugt|generiert|erstellt)"
    r"|(ce fichier|fichier|code) (est |a été )?(produit|généré|créé)|(este )?(archivo|fichero|código) (es |fue )?(creado|generado|producido)|autogenerado|généré (par|automatiquement)",
    re.I,
)
#: Marks that a tool leaves within or below its output, on comment lines of their own, always with the tool's version.
TOOL_MARK = re.compile(
    r"^[ \t]*(?://|#|/?\*)[ \t]*-*[ \t]*(?:(?:eof |file )?(?:emitted|written|produced|generated|created|built) by|end of (?:output|file|generated code),?|(?:record|part|chunk|section) \d+ of \d+,)"
    r"[ \t]+[\w.-]+[ \t]+v?\d+(?:\.\d+)+",
    re.I | re.M,
)
#: Notices that say where a copy comes from.
COPY_NOTICE = re.compile(
    r"part of (the )?[\w.-]+ (distribution|library|package|project)\b|(copied|imported|vendored|taken|adapted|borrowed) (\w+ )?(from|at|verbatim|unmodified)\b|upstream(:| (source|version|commit))"
    r"|[\w.-]+ v?\d+(\.\d+)+ - a \w+ library|redistribution and use in source|released under (a|the) [\w -]*licen[cs]e|licen[cs]e: see|spdx-filecopyrighttext:|/?\*?! [\w.-]+ v\d",
    re.I,
)
COPYRIGHT = re.compile(r"(?:copyright|\(c\)|©|spdx-filecopyrighttext:)\s*(?:\(c\)\s*|©\s*)?(?:[\d,\s-]+)?\s*(?:by\s+)?(.*)", re.I)
_NUMBERED = re.compile(r"\b(?:def|function|fn|func(?:\s*\([^()]*\))?)\s+([A-Za-z_$][\w$]*?)_?(\d+)\s*[(<]")
_FUNCTION = re.compile(r"^(?:export\s+|default\s+|async\s+|pub(?:\([^)]*\))?\s+|unsafe\s+)*(?:def|function|fn|func)\b", re.M)

#: Least share of tokens in units of repeated shapes, least number of such units and of their tokens, and largest share of
#: lines off the canonical form, of a uniform file.
REPEATED, REPEATED_UNITS, REPEATED_TOKENS, DEVIATION = 0.9, 12, 80, 0.02
#: Least expansion of minified code, the one that suffices where the reasons name mangled subjects, and largest share of names in data.
EXPANSION, MANGLED_EXPANSION, NAMES = 5, 3, 0.02
#: Kinds that a reason may state, by its first words.
STATED = {"vendored": "vendored|third[- ]party|copied from", "minified": "minified|bundled", "generated": "generated|auto-?generated", "data": "data file|literal data"}

FEATURES = "file_path string, repo string, tool_notice boolean, copy_notice boolean, canonical_lines int, code_lines int, tokens int, names int, literals int, literal_chars long, code_chars long, functions int, series int, plain_start boolean, unit_tokens int, repeated_tokens int, repeated_units int, deviation double, delivered timestamp"


def head_lines(language: str, text: str) -> list[str]:
    """The comment lines before the first code of a file, their markers taken off."""
    out, block = [], False
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
        t = m.group().strip()
        if not t and m.end() == len(text):
            break
        if block:
            out.append(t.strip("*/ \t"))
            block = "*/" not in t
        elif not t:
            continue
        elif t.startswith("/*") and language != "python":
            out.append(("/*! " if t.startswith("/*!") else "") + t.strip("/*! \t"))
            block = "*/" not in t
        elif t.startswith("#" if language == "python" else "//"):
            out.append(t.lstrip("#/! \t"))
        else:
            break
    return out


def notices(language: str, repo: str, text: str) -> tuple[bool, bool]:
    tool, copy = bool(TOOL_MARK.search(text)), False
    own = (repo or "").lower().split("-")[0]
    for line in head_lines(language, text):
        if TOOL_NOTICE.match(line):
            tool = True
        holder = COPYRIGHT.search(line)
        if holder and (own and own in holder.group(1).lower().split() or re.search(r"\bour\b|\bteam\b", holder.group(1), re.I)):
            continue
        if COPY_NOTICE.match(line):
            copy = True
    return tool, copy


def repeats(tokens: int, repeated: int, units: int) -> bool:
    return repeated >= REPEATED * tokens and units >= REPEATED_UNITS and repeated >= REPEATED_TOKENS


def measure(language: str, text: str) -> tuple:
    """Figures of the canonical form of a file against its layout; the deviation is null where no shapes repeat or the file
    is not valid, as uniformity needs both."""
    from . import grammars, layout, lexing

    toks = lexing.tokens(language, text)
    cls, at = grammars.classes(language, toks)
    if at is not None:
        toks = [toks[k] if k < len(toks) else "" for k in at]
    count = Counter(cls)
    if language == "python":  # bare strings are documentation
        breaks = {"NL", "IN", "DE"}
        doc = [k for k, c in enumerate(cls) if c == "s" and (k == 0 or cls[k - 1] in breaks) and (k + 1 == len(cls) or cls[k + 1] == "NL")]
        canonical = count["NL"] + count[";"] - len(doc)
        skip = set(doc)
    else:
        canonical, skip = count[";"] + count["{"] + count["}"], ()
    literal = sum(len(t) for k, (t, c) in enumerate(zip(toks, cls, strict=True)) if c in ("s", "t", "n") and k not in skip)
    chars = sum(len(t) for k, (t, c) in enumerate(zip(toks, cls, strict=True)) if c and c != "\n" and k not in skip)
    marks = count[""] + count["\n"] + count["NL"] + count["IN"] + count["DE"]
    comment_lines = sum(t.count("\n") + 1 for t, c in zip(toks, cls, strict=True) if not c) + sum(toks[k].count("\n") + 1 for k in skip)
    code_lines = max(1, sum(1 for x in text.split("\n") if x.strip()) - comment_lines)
    if language in ("go", "python"):
        comment = "#" if language == "python" else "//"
        code_lines = max(1, sum(1 for x in text.split("\n") if x.strip() and not x.lstrip().startswith(comment)) - sum(toks[k].count("\n") + 1 for k in skip))
    series = Counter(a.lower() for a, _ in _NUMBERED.findall(text))
    first = next((c for k, c in enumerate(cls) if c and c != "\n" and k not in skip), "")
    units = layout.repeated_shapes(language, cls)
    deviation = layout.deviation(language, text) if repeats(*units) and grammars.parse(language, text)[0] == "ok" else None
    return (canonical, code_lines, len(toks) - marks - len(skip), count["i"] + count["m"], count["s"] + count["t"] + count["n"] - len(skip), literal, chars, len(_FUNCTION.findall(text)), max(series.values(), default=0), first not in ("{", "[", "X", "<", "b"), *units, deviation)


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import lexing

    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    for batch in batches:
        paths, repos, sources, times = (batch.column(c) for c in ("file_path", "repo", "source_bytes", "delivered"))
        rows = []
        for path, repo, source in zip(paths.to_pylist(), repos.to_pylist(), sources, strict=True):
            lang, text = lexing.language_of(path), lexing.decode(source.as_buffer() if source.is_valid else b"")
            rows.append(notices(lang, repo or path.split("/")[0], text) + measure(lang, text))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([paths, repos, *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), times], names)


def features(files: DataFrame) -> DataFrame:
    """One narrow row of figures per source file; sources are not shuffled."""
    raw = files.filter(is_source(F.col("file_path"))).select("file_path", "repo", "source_bytes", F.col("ingested_at").cast("timestamp").alias("delivered"))
    mapped = raw.mapInArrow(feature_batches, FEATURES)
    kept = [c for c in mapped.columns if c not in ("file_path", "delivered")]
    last = F.max_by(F.struct(*kept), F.coalesce("delivered", F.lit("1970-01-01").cast("timestamp")))
    return mapped.groupBy("file_path").agg(last.alias("f")).select("file_path", "f.*")


def kind() -> Column:
    """The reason why a file was not written by hand, null when it was. Thresholds lie in wide gaps of the figures: minified is code that
    its canonical form expands ``EXPANSION`` times or more (hand-written code at most 3 times, minified code from about 15 times on),
    data has a name in less than ``NAMES`` of its tokens (hand-written code in 0.1 or more)."""
    p = F.col("file_path")
    dirs = F.transform(F.slice(F.split(F.lower(p), "/"), 2, 1_000), lambda x: F.regexp_replace(x, r"-\d+(\.\d+)*$", ""))
    folders = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    name = F.element_at(F.split(p, "/"), -1)
    expansion = F.col("canonical_lines") / F.col("code_lines")
    tokens = F.greatest("tokens", F.lit(1))
    vendored = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in VENDOR_DIRS.split()])) | F.col("copy_notice")
    stated = lambda k: F.coalesce(F.col("stated") == k, F.lit(False))
    mangled = (F.col("offers") >= 2) & (F.col("mangled") * 2 >= F.col("offers")) & (expansion >= MANGLED_EXPANSION)
    minified = name.rlike(MINIFIED_NAME) | ((expansion >= EXPANSION) | mangled) & (F.col("canonical_lines") >= 20)
    uniform = (F.col("series") >= 3) & (F.col("series") >= 0.9 * F.col("functions")) | F.coalesce(F.col("deviation") <= DEVIATION, F.lit(False))
    generated = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in GENERATED_DIRS.split()])) | name.rlike(GENERATED_NAME) | F.col("tool_notice") | uniform
    data = F.col("plain_start") & (F.col("code_chars") >= 200) & (
        (F.col("names") / tokens < NAMES) & (F.col("literals") / tokens >= 0.3) | (F.col("literal_chars") / F.col("code_chars") >= 0.9))
    return F.when(vendored | stated("vendored"), "vendored").when(minified | stated("minified"), "minified").when(generated | stated("generated"), "generated").when(data | stated("data"), "data")


def report(candidates: DataFrame, packaged: DataFrame, files: DataFrame) -> DataFrame:
    """Every offered source file with its figures, its kind (null: hand-written) and how often it is offered."""
    path = F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path")
    subject = F.regexp_replace(F.coalesce("reason", F.lit("")), r"^(called by|\S+) ", "")
    told = F.lit(None).cast("string")
    for k, words in STATED.items():
        told = F.when(F.col("reason").rlike(rf"(?i)^(evidence:\s*)?({words})\b"), k).otherwise(told)
    row = (path, told.alias("stated"), subject.rlike(r"^\w{1,2}(\.\w{1,2})*$").alias("mangled"))
    offered = candidates.select(*row).unionByName(packaged.select(*row)).filter("file_path is not null").groupBy("file_path").agg(
        F.count("*").alias("offers"), F.max("stated").alias("stated"), F.count_if("mangled").alias("mangled"))
    return features(files).join(offered, "file_path").withColumn("kind", kind())


def found(candidates: DataFrame, packaged: DataFrame, files: DataFrame) -> DataFrame:
    return report(candidates, packaged, files).filter("kind is not null").select("file_path")
