import random

import pytest
from tokenizers import Tokenizer

from lodestone.llm import p6_tokenizer as P


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(P.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_and_round_trip(public):
    rnd = random.Random(3)
    pool = [chr(c) for c in [*range(32, 127), *range(160, 1000), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640), 9, 10, 13, 0x200B, 0x3000, 0x301, 0x660, 0xBD, 0x1C]]
    texts = ["", "a", " ", "\n\n  x\n", "it's we'LL", "<|endoftext|>", "x" * 20_000, " " * 5_000, "ab " * 50_000] + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 200))) for _ in range(300)]
    e = P.encoder(P.VOCABULARY)
    values, offsets = e.encode_all(texts)
    want = public.encode_batch(texts, add_special_tokens=False)
    for k, t in enumerate(texts):
        ids = values[offsets[k] : offsets[k + 1]].tolist()
        assert ids == want[k].ids
        assert e.decode(ids) == t


def test_query(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    rows = P.encode(docs).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in rows) == [(0, (64,)), (1, (15496, 995)), (1, (15496, 995)), (2, ()), (3, ())]
    assert P.encode(docs.limit(0)).count() == 0 and P.encode(docs).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_the_memo_may_be_emptied():
    e = P.Encoder(P.VOCABULARY, most=3)
    for _ in range(3):
        values, offsets = e.encode_all(["one two three four five six", "seven"])
        assert e.decode(values[: offsets[1]].tolist()) == "one two three four five six"
