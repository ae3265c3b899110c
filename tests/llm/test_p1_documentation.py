import ast
import datetime as dt

from pyspark.sql import functions as F

from lodestone.llm import p1_documentation as P

T0 = dt.datetime(2024, 1, 1)
FILES = "file_id long, repo string, file_path string, source_bytes binary, language string, ingested_at timestamp, name string"
SYMBOLS = "id string, name string, kind string, file_path string, start_line int, end_line int, style string, text string"

TS = '''/**
 * Decides whether the queue may grow further.
 * @param x the size
 */
@dec("}")
export function grow(x) {
    const s = "{ // no";
    return x;
}

/** Grows a bit. */
function small() {}

/** This comment is followed by a blank line here. */

function blank() {}

// Not a doc comment even though it is long enough.
function plain() {}

/** @param a one thing that is long enough */
function tagged(a) {}

/** resolve header table */
function resolveHeaderTable() {}
/** Cleans the old cache entries away. */ function sameLine() {}
'''
PY = '''def a():
    """Walks over all files in path order."""
    return 1

@dec
def b(
    x,
):
    # a comment between
    r"""
    Args:
        x: something that is described here at length
    """

def c():
    f"""An f-string is no documentation at all."""

def d():
    x = 1
    "Not the first statement of this function body."

class K:
    async def e(self): return 1
    def f(self):
        'Counts the pending rows of one table.'
'''
GO = '''package a

// Get matcher
func GetMatcher() {}

/* Returns the rows in stable order.
*/
func Rows() {}

func code() {} // trailing comment that is long enough
func none() {}
'''
RUST = '''/// Returns the rows in stable order.
#[inline]
#[cfg(test)]
pub fn rows() {}

// plain comment that is long enough to count
fn plain() {}

/// * `x` - the row that is read
fn only_args(x: u8) {}
'''
JAVA = '''class A {
    /**
     * Keeps the cache warm for {@code X} users.
     */
    @Override
    @Named("{")
    public void warm() {
    }
}
'''


def tables(spark):
    files = [(1, "r", "r/a.ts", TS.encode(), "typescript", T0, "clash"), (2, "r", "r/a.py", PY.encode(), "python", T0, "clash"), (3, "r", "r/a.go", GO.encode(), "go", T0, None), (4, "r", "r/a.rs", RUST.replace("\n", "\r\n").encode(), "rust", T0, None), (5, "r", "r/A.java", JAVA.encode(), "java", T0, None), (6, "r", "r/null.py", None, "python", T0, None), (1, "r", "r/a.ts", TS.encode(), "typescript", T0 + dt.timedelta(1), None), (7, "r", None, b"x", None, None, None)]
    at = lambda text, needle: text[: text.index(needle)].count("\n") + 1
    symbols = []
    for path, text, names in (("r/a.ts", TS, ["grow", "small", "blank", "plain", "tagged", "resolveHeaderTable", "sameLine"]), ("r/a.py", PY, ["a", "b", "c", "d", "e", "f"]), ("r/a.go", GO, ["GetMatcher", "Rows", "code", "none"]), ("r/a.rs", RUST, ["rows", "plain", "only_args"])):
        for n in names:
            line = at(text, f" {n}(" if path != "r/a.go" else f"func {n}(")
            symbols.append((n, n, "function", path, line, line + 1, "clash", "clash"))
    symbols.append(("warm", "warm", "method", "r/A.java", 5, 8, None, None))
    symbols += [("grow", "grow", "function", "r/a.ts", 6, 9, None, None), ("class", "A", "class", "r/A.java", 1, 9, None, None), (None, None, None, None, None, None, None, None), ("gone", "gone", "function", "r/none.py", 1, 2, None, None)]
    return spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(files, FILES)


def test_found(spark):
    symbols, files = tables(spark)
    assert {r["id"] for r in P.found(symbols, files).collect()} == {"grow", "a", "f", "Rows", "rows", "warm"}


def test_pairs_hold_code_and_description(spark):
    symbols, files = tables(spark)
    got = {r["id"]: r for r in P.pairs(symbols, files).collect()}
    assert got["grow"]["description"] == "Decides whether the queue may grow further." and got["grow"]["code"].startswith("export function grow")
    assert got["warm"]["code"].startswith("    @Override") and got["warm"]["description"] == "Keeps the cache warm for X users."
    assert got["rows"]["code"].split("\n")[0] == "pub fn rows() {}"


def test_functions_come_from_depth(spark):
    _, files = tables(spark)
    got = {(r["file_path"], r["name"]): (r["start_line"], r["end_line"]) for r in P.functions(P.lexed(files)).collect()}
    assert got[("r/a.ts", "grow")] == (6, 9) and got[("r/A.java", "warm")] == (5, 8)
    assert got[("r/a.py", "a")] == (1, 3) and got[("r/a.py", "b")] == (6, 13) and got[("r/a.py", "e")] == (23, 23) and got[("r/a.py", "f")] == (24, 25)


def test_calls_are_no_methods(spark):
    text = "class A {\n  void run() {\n    help(1);\n    if (x) {\n      public y(2);\n    }\n  }\n  abstract int size();\n}\n"
    files = spark.createDataFrame([(1, "r", "r/B.java", text.encode(), "java", T0, None)], FILES)
    assert {(r["name"], r["start_line"], r["end_line"]) for r in P.functions(P.lexed(files)).collect()} == {("run", 2, 7), ("size", 8, 8)}


def test_places_ends_and_names_equal_the_symbol_table(spark):
    d = "/root/testdata/sf0.01/"
    symbols = spark.read.parquet(d + "symbols.parquet").filter("kind in ('function', 'method')").select("file_path", "start_line", "end_line", "name").distinct()
    found = P.functions(P.lexed(spark.read.parquet(d + "files.parquet"))).select("file_path", "start_line", "end_line", "name")
    assert symbols.count() > 2000 and symbols.join(found, ["file_path", "start_line", "end_line", "name"], "left_anti").count() == 0


def test_empty_tables(spark):
    symbols, files = tables(spark)
    assert P.found(symbols.limit(0), files).count() == 0 and P.found(symbols, files.limit(0)).count() == 0


def test_docstrings_agree_with_the_compiler(spark):
    """Of all parsable Python files, the docstrings found are those that ast finds."""
    files = spark.read.parquet("/root/testdata/sf0.01/files.parquet").filter("lower(file_path) like '%.py'")
    got = {(r["file_path"], r["at"]) for r in P.functions(P.lexed(files)).filter("lang = 'python' and style = 'string'").select("file_path", F.col("start_line").alias("at")).collect()}
    broken, want = set(), set()
    for r in files.select("file_path", "source_bytes").distinct().collect():
        try:
            tree = ast.parse(bytes(r["source_bytes"] or b""))
        except SyntaxError:
            broken.add(r["file_path"])
            continue
        want |= {(r["file_path"], n.lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n, clean=False) is not None}
    assert {x for x in got if x[0] not in broken} == want
