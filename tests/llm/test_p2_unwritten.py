import datetime as dt

import pytest

from lodestone.llm import p2_unwritten as P

T0 = dt.datetime(2024, 1, 1)
HAND = b"import os\n\ndef load(path, limit):\n    rows = []\n    for line in open(path):\n        rows.append(line.strip())\n    return rows[:limit]\n\ndef main():\n    print(load('x', 3))\n"
NUMBERED = "".join(f"function visit_{k}(a) {{\n    return call(a, {k});\n}}\n\n" for k in range(6)).encode()
MINIFIED = ("!function(a){" + "".join(f"var b{k}=a.c||{{}};if(!b{k})throw new Error('x');" for k in range(60)) + "}(d);").encode()
DATA = ("ROWS = [\n" + "".join(f'    {{"a": {k}, "b": "v{k}"}},\n' for k in range(40)) + "]\n").encode()


@pytest.mark.parametrize("path,source,kind", [
    ("r/src/hand.py", HAND, None),
    ("r/vendor/lib/hand.py", HAND, "vendored"), ("r/deps-2.1/x/hand.py", HAND, "vendored"), ("r/vendor_portal/hand.py", HAND, None), ("r/src/vendor_scan.py", HAND, None),
    ("r/src/generated/hand.py", HAND, "generated"), ("r/generator/hand.py", HAND, None), ("r/src/x_pb2.py", HAND, "generated"), ("r/src/x.g.ts", b"const a = 1;\n", "generated"),
    ("r/src/a.py", b"# Code generated by tool 1.2. DO NOT EDIT.\n" + HAND, "generated"), ("r/src/b.py", b"#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n# Automatisch erzeugt aus x.csv. Nicht von Hand bearbeiten.\n" + HAND, "generated"),
    ("r/src/c.py", b"# Checks that nobody edits files carrying the @generated marker by hand.\n" + HAND, None), ("r/src/d.py", HAND + b"# Code generated by tool. DO NOT EDIT.\n", None),
    ("r/src/q.py", HAND + b"\n# EOF written by tool v1.6.7\n", "generated"), ("r/src/r.ts", b"const a = f(1);\n// --- record 2 of 9, tool 1.2.3 ---\nconst b = f(2);\n", "generated"), ("r/src/s.py", HAND + b"\n# The report is written by tool number 3 of 4\n", None),
    ("r/src/e.py", b"# Copyright 2024 the r team, all rights reserved.\n" + HAND, None), ("r/src/f.ts", b"/*\n * Copied from lib (tag v1), local changes: none\n */\nconst a = f(b);\n", "vendored"),
    ("r/src/g.js", NUMBERED, "generated"), ("r/src/h.js", MINIFIED, "minified"), ("r/src/i.min.js", b"a(b);", "minified"),
    ("r/src/j.py", DATA, "data"), ("r/src/k.py", b"X = '" + b"q" * 400 + b"'\n", "data"), ("r/src/l.py", b'"""' + b"words of a long module docstring " * 20 + b'"""\n', None),
    ("r/src/m.java", b'{"a": 1, "b": [1, 2, 3], "c": {"d": "' + b"x" * 300 + b'"}}', None), ("r/src/n.py", b"", None), ("r/src/o.py", None, None), ("r/src/p.py", HAND + b"X = '" + b"q" * 150 + b"'\n", None),
])
def test_kinds(spark, path, source, kind):
    files = spark.createDataFrame([(path, "r", source, T0, "x")], "file_path string, repo string, source_bytes binary, ingested_at timestamp, kind string")
    offered = spark.createDataFrame([("./" + path, "calls x"), (path, None), (None, "x")], "file_path string, reason string")
    got = [r["kind"] for r in P.report(offered, offered, files).collect()]
    assert got == [kind]


def test_only_offered_files_once(spark):
    files = spark.createDataFrame([("r/vendor/a.py", "r", HAND, T0), ("r/vendor/a.py", "r", HAND, T0 + dt.timedelta(1)), ("r/vendor/b.py", "r", HAND, None), ("r/vendor/c.md", "r", b"# x", T0)], "file_path string, repo string, source_bytes binary, ingested_at timestamp")
    offered = spark.createDataFrame([("./r/vendor/a.py", None), ("r/vendor/a.py", "x"), ("r/vendor/c.md", None), ("r/none.py", None)], "file_path string, reason string")
    empty = offered.limit(0)
    assert [r[0] for r in P.found(offered, empty, files).collect()] == ["r/vendor/a.py"]
    assert P.found(empty, empty, files).count() == 0 and P.found(offered, offered, files.limit(0)).count() == 0


def test_reasons_tell(spark):
    squeezed = ("".join(f"a{k}=f(a);" for k in range(4)) + "\n") * 6
    files = spark.createDataFrame([("r/a.py", "r", HAND, T0), ("r/b.js", "r", squeezed.encode(), T0), ("r/c.js", "r", squeezed.encode(), T0)], "file_path string, repo string, source_bytes binary, ingested_at timestamp")
    offered = spark.createDataFrame([("r/a.py", "evidence: vendored copy of a parser"), ("r/b.js", "calls e.n"), ("r/b.js", "called by c"), ("r/c.js", "calls vendoredThing"), ("r/c.js", "defines load")], "file_path string, reason string")
    got = {r["file_path"]: r["kind"] for r in P.report(offered, offered.limit(0), files).collect()}
    assert got == {"r/a.py": "vendored", "r/b.js": "minified", "r/c.js": None}


TYPES = "import { Base } from './base';\n\n" + "".join(f"export interface {n}Message extends Base {{\n    id: number;\n    {n.lower()}: string[];\n}}\n\n" for n in "Ant Bee Cat Dog Elk Fox Gnu Hen Ibis Jay Kite Lynx Mole Newt".split())


@pytest.mark.parametrize("path,source,kind", [
    ("r/src/types.ts", TYPES, "generated"),
    ("r/src/loose.ts", TYPES.replace(": ", " :").replace("    id", "  id"), None),
    ("r/src/few.ts", TYPES[: TYPES.index("export interface Dog")], None),
    ("r/src/codes.go", "package codes\n\n" + "".join(f"const Code{n} = \"{n}\"\n" for n in "Ant Bee Cat Dog Elk Fox Gnu Hen Ibis Jay Kite Lynx Mole Newt Owl Pig Rat Sow Tit Yak".split()), "generated"),
    ("r/src/tight.py", "".join(f"{n} ='{n}'\n" for n in "abcdefghijklmnopqrstuvwxyz"), None),
    ("r/src/map.py", "".join(f"{n}:\n  x: {k}\n  - y: [z]\n" for k, n in enumerate("abcdefghijklmnop")), None),
])
def test_uniform_layout_and_shapes(spark, path, source, kind):
    test_kinds(spark, path, source.encode(), kind)


@pytest.mark.parametrize("language,text", [
    ("go", "package a\n\nimport (\n\t\"log\"\n)\n\n// f\nfunc F(x []string, n *T) map[string]int {\n\tfor i := 0; i < n; i++ {\n\t\tlog.Println(x[i], -n)\n\t}\n\treturn map[string]int{\"a\": 1}\n}\n"),
    ("typescript", "export async function f(a: string, b?: number) {\n  if (!a) {\n    return null;\n  } else {\n    g(a, { b, c: [1, 2] });\n  }\n  const x = a.map((y) => y + 1);\n}\n"),
    ("java", "public class A {\n    @Override\n    public int f(int[] a, int b) {\n        return a[0] + -1;\n    }\n}\n"),
    ("rust", "pub(crate) fn f(x: &str) -> Option<u32> {\n    let v = vec![1, 2];\n    Some(v.len() as u32)\n}\n"),
    ("python", "import os\n\n\ndef f(a, b=1, *c):\n    if not a:\n        return [x for x in b]\n    return {'a': -1}\n"),
])
def test_canonical_text(language, text):
    from lodestone.llm import layout

    assert layout.deviation(language, text) == 0
    assert layout.deviation(language, text.replace(", ", ",")) > 0
    if language != "python":  # line ends are Python's syntax
        flat = " ".join(line for line in text.split("\n") if not line.startswith("//"))
        assert language == "go" or layout.canonical_text(language, flat).count("\n") >= 3
    assert layout.canonical_text(language, text).split() == [w for line in text.split("\n") if not line.startswith("//") for w in line.split()]
