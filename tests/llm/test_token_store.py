import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzframe.llm import token_store as ts
from quartzframe.llm.wordbpe import WordBpe

PATH = ts.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["it's <|endoftext|> we'll Straße  \t x́ İstanbul ΣΑΣ 'S don'T 12,3. ###$$ a\r\nb\x1cc", "", "   ", None, "Ünï é 日本語。", "<|startoftext|>x Don't.'s", "a_b-c!! A.B c.,. É. ǅ Ž", "word " * 5000, "the same passage again " * 400, "x " + "the same passage again " * 400]


def want(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aB .,'<|>\né́", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(texts):
    ids, bounds = BPE.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


BPE = WordBpe(PATH, most=50)


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_crc_join(a, b):
    assert ts.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 49000, 30000)

    def pieces(ids):
        ends = ts.cut(ts.cut_places(ids).tolist(), 0, len(ids))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    plain, moved = pieces(body), pieces(np.concatenate([rng.integers(0, 49000, 77), body]))
    assert b"".join(plain) == body.tobytes() and len(set(plain) & set(moved)) > len(plain) * 0.7
    assert all(len(p) // body.itemsize <= ts.MOST for p in plain)


def test_store_round_trip_and_facts(spark, table, tmp_path):
    docs = table(*[(5 * i, t) for i, t in enumerate(TEXTS)], (3, TEXTS[8]), (3, TEXTS[8]), (None, "no id"), extra=True).repartition(3)
    folder = f"file://{tmp_path}/store"
    ts.write(docs, folder, PATH, 2)
    order = [(None, "no id"), (0, TEXTS[0]), (3, TEXTS[8]), (3, TEXTS[8]), *[(5 * i, t) for i, t in enumerate(TEXTS) if i]]
    start, expected = 0, []
    for key, t in order:
        ids = want(t, 2)
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in ts.read_facts(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected
    back = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in ts.read_ids(spark, folder).collect()), key=lambda r: r[1])
    assert [np.frombuffer(r[2], "<u4").tolist() for r in back] == [want(t, 2) for _, t in order]
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_damage_is_found(spark, table, tmp_path):
    folder = f"file://{tmp_path}/store"
    ts.write(table((1, "one text"), (2, "another text")), folder, PATH, 2)
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    bad = [(bytes(r["hash"]), r["n"], b"\2\1\0" if i == 0 else bytes(r["ids"])) for i, r in enumerate(chunks)]
    spark.createDataFrame(bad, "hash binary, n int, ids binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="damaged"):
        ts.read_facts(spark, folder).collect()
    spark.createDataFrame(bad[1:], "hash binary, n int, ids binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="missing"):
        ts.read_facts(spark, folder).collect()


def test_empty_table(spark, table, tmp_path):
    ts.write(table(), f"file://{tmp_path}/store", PATH, 2)
    assert ts.read_facts(spark, f"file://{tmp_path}/store").count() == 0
