import hashlib
import random

import public_tokenizers as P
import pytest
from llm_data import ODD

from lurescan.llm import sentence_pieces

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel(MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(lib, text):
    ids = lib.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))


def test_rows_equal_the_library(documents, rows, odd, empty, lib):
    for df, own in ((documents, rows), (odd, ODD)):
        got = {r.doc_id: r for r in sentence_pieces.encode(df, MODEL).collect()}
        assert len(got) == len(own)
        for i, t in own:
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == row(lib, t)
            assert got[i].ids == lib.encode(t or "")
    assert sentence_pieces.encode(empty, MODEL).count() == 0


def test_repeated_and_null_ids(spark, lib):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x  y"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.encode(df, MODEL).collect())
    assert got == sorted((i or 0, *row(lib, t)) for i, t in [(1, "one two"), (1, "one two"), (None, "x  y"), (None, None), (2, "")])


def test_decode_of_rows(spark, odd, lib):
    coded = sentence_pieces.encode(odd, MODEL)
    got = {r.doc_id: r.text for r in sentence_pieces.decode(coded, MODEL).collect()}
    assert got == {i: (t or "").replace("▁", " ") for i, t in ODD}
    odd_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in sentence_pieces.decode(odd_ids, MODEL).collect()] == ["", ""]


def test_random_texts(model, lib):
    rng = random.Random(5)
    wide = [chr(c) for c in [*range(1, 0x250), 0x2581, 0x4E00, 0x4E2D, 0x1F389, 0x301]]
    for letters in (wide, list(" ▁eatinorshl;)\r}(="), list("aé 漢1\n"), list(" t")):
        for _ in range(700):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 70)))
            assert model.encode(text) == lib.encode(text)
    for text in ("the" * 5000, " " * 33 + "x" + " " * 17, "x" * 3000, "<s>hi</s> <0x41>", "\x00a\x00", "▁x▁▁y"):
        assert model.encode(text) == lib.encode(text)


def test_random_ids(model, lib):
    rng = random.Random(6)
    few = [0, 1, 2, *range(3, 259), 29871, 259, 262]
    for k in range(3000):
        ids = [rng.randrange(32_000) if k % 2 else rng.choice(few) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == lib.decode(ids)


def test_search_goes_back(model):
    """Texts whose longest pieces do not fit: failed places are marked and left by shorter pieces."""
    rng = random.Random(7)
    backs = 0
    for _ in range(2000):
        text = "".join(rng.choice("abcdeinorst") for _ in range(30))
        longest = model.longest(text)
        tokens = [model.pieces[t] for t in model.search(longest, 0, len(text))]
        assert tokens == model.merge(text)
        at, greedy = 0, []
        while at < len(text):
            greedy.append(model.pieces[longest[at]])
            at += len(greedy[-1])
        backs += greedy != tokens
    assert backs > 100


def test_starting_over(monkeypatch, lib):
    import pyarrow as pa

    monkeypatch.setattr(sentence_pieces, "INDEX_UNITS", 3)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 2)
    index = sentence_pieces.UnitIds(sentence_pieces.PieceModel(MODEL))
    for text in ("one two three four", "five six", "one two three four", "unbelievablest wordings"):
        ids, at = index.ids(pa.array([text, "", text]))
        assert ids.tolist() == lib.encode(text) * 2 and at.tolist() == [0, len(ids) // 2, len(ids) // 2, len(ids)]


def test_other_models_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(str(path))


def test_short_units_are_searched_in_lockstep(model, lib, monkeypatch):
    """Odd words, most of which need the search to go back: the same tokens as one by one, which only the last few are."""
    rnd = random.Random(5)
    units = sorted({" " + "".join(rnd.choice("aeinrstéß漢😀0.,") for _ in range(rnd.randint(1, 30))) for _ in range(3000)})
    alone = [model.search(model.longest(u.replace(" ", "▁")), 0, len(u)) for u in units]
    asked = []
    one = model.search
    monkeypatch.setattr(model, "search", lambda *a: asked.append(a) or one(*a))
    flat, sizes = model.encode_units(units)
    assert len(asked) <= sentence_pieces.FEWEST
    assert flat.tolist() == [x for u in units for x in lib.encode(u[1:])]
    spelt = [sum(1 if t < model.size else len(chr(t - model.size).encode()) for t in found) for found in alone]
    assert sizes.tolist() == spelt
