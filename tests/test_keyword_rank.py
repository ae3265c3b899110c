import re

from lodestone.plans import text_queries as Q


def test_every_keyword_counts(spark, tmp_path):
    prompt = "Explain how the first_window Reader merges packages, and why quota limits the cache index."
    texts = ["The cache is a CACHE; uncached indexes: cache_index.", "first_window reader merges packages", "quota quota readers aaa", None, "nothing of it", "how the path why"]
    spark.createDataFrame([(1, prompt), (2, None), (3, "aaa")], "item_id long, task_prompt string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for item, p in ((1, prompt), (3, "aaa")):
        keywords = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", p)} - set(Q.NAIVE_STOPWORDS)
        hits = [(k, sum(t.lower().count(w) for w in keywords)) for k, t in enumerate(texts) if t]
        for rank, (k, n) in enumerate(sorted((h for h in hits if h[1]), key=lambda h: (-h[1], h[0])), 1):
            want[item, k] = (n, rank)
    got = {(r["item_id"], r["doc_id"]): (r["hits"], r["rank"]) for r in Q.keyword_rank(spark, str(tmp_path)).collect()}
    assert got == want and want[1, 0][0] >= 5
