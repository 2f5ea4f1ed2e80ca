import collections
import hashlib
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzframe.llm import alignment as al
from quartzframe.llm.token_store import tokenizer_path

DATA = "/root/testdata/sf0.001"
A, B = tokenizer_path(al.FIRST), tokenizer_path(al.SECOND)


def spans(text):
    """(id, first byte, byte behind the last) of both tokenizers over the whole text, or nothing."""
    a, b, a_bytes, b_bytes = al.tokenizers_of(A, B)
    if not text:
        return [], []
    found = []
    for ids, by in ((a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)):
        if b"".join(by[i] for i in ids) != (" " + text).encode():
            return [], []
        at, out = 0, []
        for i in ids:
            out.append((i, at, at := at + len(by[i])))
        found.append(out)
    return found


def brute(texts):
    """Figures of each text, every pair of tokens compared."""
    facts, holders = [], collections.Counter()
    for text in texts:
        a, b = spans(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        holders.update(set(links))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, at = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= c) for side in (a, b)))
            at = c
        facts.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    return [(n_a, n_b, n_groups, len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), sha) for n_a, n_b, n_groups, links, sha in facts]


def held(spark, table, texts, **kinds):
    docs = table(*enumerate(texts), **kinds)
    got = {r["doc_id"]: tuple(r)[1:] for r in al.align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    return got


TEXTS = [
    None, "", " ", "a", "The house, the houses. It's 12 o'clock!", "The house, the houses. It's 12 o'clock!", "naïve café Straße 東京都 日本語のテキスト 🙂🙂 ab",
    "  two  blanks\n\nlines\t tabs \n end ", "<|endoftext|> </s> <s> <0x41> <unk>", "with ▁ inside, the house", "▁", "x▁y the", "nul \x00 and \r\n",
    "-" * 300 + "=" * 77, "supercalifragilistic " * 40, "word word thin 　wide", "é combining ‍ joined",
]


def test_texts_against_every_pair_of_tokens(spark, table):
    got = held(spark, table, TEXTS, extra=True)
    assert got[0][-1] == "" and got[9][0] == 0 and got[4] == got[5]


def test_small_buckets_give_the_same(spark, table, monkeypatch):
    monkeypatch.setattr(al, "BUCKET_CHARS", 200)
    monkeypatch.setattr(al, "MOST_BROADCAST", 0)
    held(spark, table, TEXTS * 3)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | st.text("ab .,'\n▁é東1", max_size=60))
def test_words_are_tokenized_as_in_their_text(text):
    """Cutting at BORDER and tokenizing the words gives the tokens of the whole text."""
    import regex

    a, b, _, _ = al.tokenizers_of(A, B)
    words = regex.split(al.BORDER, text) if text else []
    assert [i for w in words for i in a.encode(" " + w, add_special_tokens=False).ids] == (a.encode(" " + text, add_special_tokens=False).ids if text else [])
    assert [i for w in words for i in b.encode(w)] == (b.encode(text) if text else [])


def test_repeated_rows_null_ids_and_empty_tables(spark, table):
    docs = table((1, "same words"), (1, "same words"), (None, "same words"), (None, None))
    got = [tuple(r) for r in al.align(docs, A, B).collect()]
    want = brute(["same words"] * 3)[0]
    assert sorted(got, key=repr) == sorted([(1, *want), (1, *want), (None, *want), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)
    assert al.align(table(), A, B).count() == 0


def test_without_common_borders_texts_stay_whole(spark, table, monkeypatch):
    monkeypatch.setattr(al, "cut_at_spaces", lambda *_: False)
    held(spark, table, TEXTS[:9])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_sample_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 1500")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), brute([r["text"] for r in rows])))
    assert {r["doc_id"]: tuple(r)[1:] for r in al.align(docs, A, B).collect()} == want


def test_totals_hold_no_object_for_each_word():
    n = 200_000
    words = pa.record_batch({"row": pa.array(np.zeros(n, np.int64)), "doc_id": pa.nulls(n, pa.int64()), "pos": pa.array(np.arange(n, dtype=np.int32)), "same": pa.array(np.ones(n, bool)),
                             "groups": pa.array(["1|2", None] * (n // 2)), **{c: pa.array(np.ones(n, np.int64)) for c in al.COUNTS}})
    tracemalloc.start()
    out = [r for b in al.totals(iter([words])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = ";".join(["1|2", ""] * (n // 2)).encode()
    assert out == [{"doc_id": None, **dict.fromkeys(al.COUNTS, n), "groups_sha256": hashlib.sha256(want).hexdigest()}]
    assert peak < 8 << 20
