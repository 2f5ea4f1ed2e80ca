import numpy as np
import pyarrow as pa
import pytest

from quartzframe.llm import sp_dropout as s
from quartzframe.llm.token_store import tokenizer_path

PATH = tokenizer_path(s.MODEL)
TEXTS = ["Hello world, reading international readings.", "a  b", "  lead", " x", "x ", "", "\n", "\n\na \n b\n", "日本語 text\t\x00é ▁ y▁z", None, "tab\tand   many    spaces", "word" * 3000, "der Fluß\nÉté naïve"]


def test_without_dropout_it_is_the_library():
    import sentencepiece

    model, cutter = sentencepiece.SentencePieceProcessor(model_file=PATH), s.Segmenter(PATH, s.Dropout(rate=0))
    for t in TEXTS:
        if t and "▁" not in t and "\0" not in t:
            assert cutter.batch(pa.array([t]), np.array([3]))[0].tolist() == model.encode(t) == cutter.text(t)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_the_ways_to_cut_agree(rate):
    cutter = s.Segmenter(PATH, s.Dropout(rate=rate, seed=9))
    units = ["▁international", "▁readings,", "▁日本", "x", "▁aé𝔘b", "▁" + "antidisestablishment" * 2, "ß" * 39]
    variants = np.arange(len(units)) % 4
    ids, lengths = cutter.units(units, variants)
    ends = np.cumsum(lengths)
    for i, u in enumerate(units):
        one = cutter.unit(u, int(variants[i]))
        assert ids[ends[i] - lengths[i] : ends[i]].tolist() == one
        assert cutter._short(u, len(u), 77) == cutter._long(u, len(u), 77) if len(u) > 1 else True
        assert b"".join(cutter.pieces.raw[k] for k in one).decode() == u.replace("▁", " ")
    if rate == 1.0:
        assert len(cutter.unit("▁reading", 0)) == 8


def test_round_trip_and_determinism(spark, table):
    docs = table(*enumerate(TEXTS), (50, TEXTS[0]), (None, "no id"), extra=True)
    ids = s.encode(docs, PATH, s.Dropout(rate=0.3)).cache()
    back = {r["doc_id"]: r["text"] for r in s.decode(ids, PATH).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS)) and back[None] == "no id"
    again = {r["doc_id"]: bytes(r["ids"] or b"") for r in s.encode(docs.repartition(3), PATH, s.Dropout(rate=0.3)).collect()}
    first = {r["doc_id"]: bytes(r["ids"] or b"") for r in ids.collect()}
    assert first == again and first[0] != first[50]
    assert all(r["lossless"] for r in s.round_trip(docs, PATH).collect())
    assert s.round_trip(table(), PATH).count() == 0


def test_a_small_cache_changes_nothing():
    a, b = s.Segmenter(PATH, s.Dropout()), s.Segmenter(PATH, s.Dropout(), most=3)
    for k in range(3):
        texts, keys = pa.array([f"some words {k} here", "and there"]), np.array([k, k + 9])
        assert a.batch(texts, keys)[0].tolist() == b.batch(texts, keys)[0].tolist()


def test_each_occurrence_is_drawn_on_its_own():
    p = s.Dropout(rate=0.3)
    cutter = s.Segmenter(PATH, p)
    words = ["international", "\nreadings", "antidisestablishment" * 3, "x", "日本"]
    texts = [" ".join(words) for _ in range(400)]
    ids, bounds = cutter.batch(pa.array(texts), np.arange(400))
    for k in range(400):
        got = ids[bounds[k] : bounds[k + 1]].tolist()
        assert cutter.pieces.decode(np.array(got)).tobytes().decode() == " " + texts[k]
    one, ends = cutter.batch(pa.array(["international"] * 400), np.arange(400))
    alone = [tuple(one[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    assert alone == [tuple(cutter.unit("▁international", s.occurrence_draws(k, 0, 1, p).tolist()[0])) for k in range(400)]
    assert len(set(alone)) > 20
    plain, ends = cutter.batch(pa.array(["a reading of\nmany " + "antidisestablishment" * 3]), np.array([7]))
    units = ["▁a", "▁reading", "▁of", "many", "▁" + "antidisestablishment" * 3]
    parts = [cutter.unit(u, d) for u, d in zip(units, s.occurrence_draws(7, 0, 5, p).tolist())]
    assert plain.tolist() == parts[0] + parts[1] + parts[2] + [cutter.pieces.byte_ids[10]] + parts[3] + parts[4]


def test_a_words_cuts_share_its_hash(monkeypatch):
    """Nodes of one word that differ in the spans skipped take the hash of the word's first node."""
    cutter, hashed, plain = s.Segmenter(PATH, s.Dropout(rate=0.3)), [], s.Segmenter._hash
    monkeypatch.setattr(s.Segmenter, "_hash", lambda self, unit: hashed.append(unit) or plain(self, unit))
    cutter.batch(pa.array(["international readings"] * 50), np.arange(50))
    assert sorted(hashed) == ["▁international", "▁readings"] and len(cutter.starts) > 20


def test_agendas_of_many_words_are_those_of_each():
    cutter, rng = s.Segmenter(PATH, s.Dropout(rate=0.2, seed=5)), np.random.default_rng(3)
    letters = list("aeinrst" * 4 + "éß日𝔘\x01.,") + ["the", "ing", "ation"]
    units = [("▁" if k % 3 else "") + "".join(rng.choice(letters, rng.integers(1, 14))) for k in range(3000)]
    units = [u[: s.SHORT + 2] for u in units] + ["", "x", "▁"]
    variants = rng.integers(0, 1 << 40, len(units))
    ids, lengths = cutter.units(units, variants)
    stops = np.append(0, np.cumsum(lengths))
    for i, u in enumerate(units):
        assert ids[stops[i] : stops[i + 1]].tolist() == (cutter.unit(u, int(variants[i])) if u else []), u
    found = cutter.pieces.ids
    splits = [(n[:k], n[k:]) for n in found for k in range(1, len(n)) if n[:k] in found and n[k:] in found]
    pairs = splits + [tuple(rng.choice(list(found), 2)) for _ in range(200)]
    places = cutter.pieces.pair(*(np.array([found[p[i]] for p in pairs]) for i in (0, 1)))
    assert cutter.pieces.pair_piece[places].tolist() == [found.get(a + b, -1) for a, b in pairs]
    assert (cutter.pieces.pair_piece[cutter.pieces.pair(np.array([-1, -1, 5]), np.array([-1, 5, -1]))] == -1).all()
