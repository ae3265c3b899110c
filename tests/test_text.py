import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T


def values(spark, column, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.select("k", column(F.col("t")).alias("v")).orderBy("k").select("v").collect()]


def test_tokens_split_case_and_underscores(spark):
    (got,) = values(spark, T.tokenize, "ConfigurationWatcher watch_configuration dynamicReload HTTPServerX")
    assert got == ["configuration", "watcher", "watch", "configuration", "dynamic", "reload", "http", "server"]


def test_stopwords_nulls_and_empty(spark):
    assert values(spark, T.tokenize, "the a of to configuration", None, "", "é") == [["configuration"], [], [], []]


@pytest.mark.parametrize("group", ["registers register registering", "services service", "watches watch watching", "loaded loads load"])
def test_inflections_meet(spark, group):
    assert len(set(values(spark, T.stem, *group.split()))) == 1


def test_words_that_stay(spark):
    words = ["class", "process", "status", "success", "bus", "ing"]
    assert values(spark, T.stem, *words) == words


def test_axes(spark):
    two, other, one = values(spark, T.axes, "X differs from Y and what Z does", "Compare joined loading versus subquery loading", "differs from eager loading")
    assert two == ["X", "Y and what Z does"]
    assert len(other) == 2 and one == ["differs from eager loading"]


def test_prefixes_in_order(spark):
    assert values(spark, T.probe_prefixes, "custom dependency cache dependency invalidation", None) == [["custom", "depend", "invali"], []]


def test_permutations(spark):
    got, single = values(spark, T.permutations, "config file loaders", "one")
    assert got[0] == "ConfigFileLoader" and "ConfigFile" in got and "configFileLoader" in got and "config_file_loader" in got
    assert single == []


def test_diff_headers(spark):
    git = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@\n-old\n+new\n+more\n"
    files = values(spark, T.modified_files, git, "### a/b.py\ntext", "--- /dev/null\n+++ b/new.py", "nothing")
    assert files == [["x.py"], ["a/b.py"], ["new.py"], []]
    assert values(spark, T.changed_lines, git, "### a/b.py\n+x", "") == [3, 0, 0]


def test_paths(spark):
    assert values(spark, lambda c: P.ancestors(P.dirname(c)), "a/b/c.py", "c.py") == [["a/b", "a", ""], [""]]
    assert values(spark, P.is_noisy, "tests/x.py", "a/foo_test.go", "a/BarTests.java", "a/latest.py") == [True, True, True, False]
    assert values(spark, P.is_sensitive, "a/.env", "a/my_credentials.json", "a/key.py", "id_rsa.pub") == [True, True, False, True]
    assert values(spark, P.name_prefix, "d/a_b.py", "d/x.py", "d/.hidden") == ["a", "x", ".hidden"]
    assert values(spark, lambda c: P.matches_glob(c, ["config*.py", "*.md"]), "x/config_a.py", "x/y.md", "x/z.py") == [True, True, False]
