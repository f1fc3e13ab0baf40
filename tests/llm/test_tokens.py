import random
from pathlib import Path

import pyarrow as pa
import pytest

from logweave.llm import tokens
from logweave.llm.tokens import TOKENIZERS, Encoded, count_tokens, encode_column, vocabulary

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS, "byte_bpe_50k.tiktoken").exists(), reason="no vocabularies")

TEXTS = [
    "Hello world, it's we'll  see\n\n  this  ", "<|endoftext|> is text", "日本語のテキスト 😀 naïve résumé", "a" * 3000, "0123456789" * 40, "\t\n \r\n   x", "ZWJ\u200d\u2028sep",
    "def f(x):\n    return x/../y\\z  # --limit 10", "Привет, мир! Ещё раз.", " ", "=" * 77 + "-" * 33,
]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(TOKENIZERS, "byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def noise(rnd):
    kind = rnd.random()
    if kind < 0.4:
        return "".join(rnd.choice("abcdeo st ingher'") for _ in range(rnd.randint(0, 50)))
    if kind < 0.7:
        return "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x400, 0x4FF), 10, 0x1F600])) for _ in range(rnd.randint(0, 40)))
    return rnd.choice("ab -=*#0") * rnd.randint(1, 200)


def test_equals_the_library_and_round_trips():
    rnd = random.Random(5)
    texts = TEXTS + [noise(rnd) for _ in range(3000)]
    v = vocabulary()
    got = [v.encode(t) for t in texts]
    assert got == library()(texts)
    assert [v.decode(ids) for ids in got] == texts


def test_appends_and_edits_equal_a_fresh_encoding():
    rnd, v = random.Random(6), vocabulary()
    for _ in range(60):
        e = Encoded(v, noise(rnd))
        for _ in range(6):
            a = rnd.randint(0, len(e.text))
            e.replace(a, min(len(e.text), a + rnd.randint(0, 9)), noise(rnd)[: rnd.randint(0, 12)])
            assert e.ids == v.encode(e.text)
        e.append(noise(rnd))
        assert e.ids == v.encode(e.text)


def test_an_edit_encodes_only_what_is_near():
    v = vocabulary()
    e = Encoded(v, "one two three four five " * 500)
    assert e.replace(6000, 6003, "xyz") < 12 and e.ids == v.encode(e.text)


def test_table(spark, monkeypatch):
    rows = [(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encode_column(df, "doc_id", "text").collect()), key=str)
    v = vocabulary()
    assert got == sorted([(1, v.encode("a b")), (2, []), (3, []), (3, []), (0, v.encode("z"))], key=str)
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0
    monkeypatch.setattr(tokens, "FLUSH", 1)  # a batch for every text
    run = tokens._encoder(TOKENIZERS, tokens.VOCABULARY)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "t": ["a b", None, "c", ""]})
    assert [r for out in run([batch]) for r in out.to_pylist()] == [
        {"k": 1, "ids": v.encode("a b")}, {"k": 2, "ids": []}, {"k": 3, "ids": v.encode("c")}, {"k": 4, "ids": []}]
    assert sorted(r["tokens"] for r in count_tokens(df, ["doc_id"], "text").collect()) == [0, 0, 0, 1, 2]
