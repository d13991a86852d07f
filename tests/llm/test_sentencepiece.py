import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import HARD, make

from folioforge.llm import sentencepiece_nbest as S

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return S.Lattice(FILE)


def every(lattice, text):
    """All segmentations of a text, best first."""
    chars = [S.SPACE if c == " " else (S._STAND_IN if c == S.SPACE else c) for c in " " + text] if text else []

    def go(i):
        if i == len(chars):
            yield 0.0, []
            return
        for j in range(i + 1, len(chars) + 1):
            if (p := lattice.ids.get("".join(chars[i:j]))) is not None:
                for s, rest in go(j):
                    yield lattice.score[p] + s, [p, *rest]
        if chars[i] not in lattice.ids:
            own = lattice.fallback(S._literal(chars[i]))
            for s, rest in go(i + 1):
                yield lattice.byte_score * len(own) + s, own + rest

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the", "to be", "a\nb", "éß x", "  hi", "日本𝄞", "an  on ", "▁x", "", "ing\n\n ed", "xxx", " a, b", "to,  be.\n of", " ", "\n", "a \n b"])
@pytest.mark.parametrize("n", [1, 2, 6])
def test_nbest_equals_all_segmentations(lattice, text, n):
    want, got = every(lattice, text), next(lattice.encode([text], n))
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
    known = {tuple(ids): s for s, ids in want}
    ids = [tuple(np.frombuffer(x, "<u2").tolist()) for _, x in got]
    assert len(set(ids)) == len(ids)
    assert [known[x] for x in ids] == pytest.approx([s for s, _ in got])
    assert all(lattice.decode(np.array(x, int)) == text for x in ids)


def test_a_long_word_and_the_memo_agree(lattice):
    small = S.Lattice(FILE, most=3)
    texts = ["ab" * 200, "the cat, sat. the dog", "the cat, sat. the dog", "x" * 65, "The  Cat"]
    for _ in range(3):
        for t in texts:
            assert list(small.encode([t], 3)) == list(lattice.encode([t], 3))


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_documents(name, request):
    got = S.encode_documents(request.getfixturevalue(name), FILE).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in HARD)
    for r in got:
        assert r.round_trip and r.n_tokens == len(r.ids) == r.nbest_tokens[0]
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True)
        assert r.nbest_crc32[0] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert len(set(r.nbest_crc32)) == len(r.nbest_crc32)


def test_empty_and_scores_of_the_file(spark, empty):
    assert S.encode_documents(empty, FILE).count() == 0
    got = S.encode_documents(make(spark, [(1, "the end", "en", "a")]), FILE, scores="file").first()
    assert got.round_trip and got.score < 0


def test_round_trip_reads_every_segmentation(lattice):
    arrays = [np.frombuffer(x, "<u2") for _, x in next(iter(lattice.encode(["the end"], 4)))]
    assert len(arrays) == 4 and S.round_trips(lattice, "the end", arrays)
    for at_once in (1, 1 << 20):
        for k in range(4):
            assert not S.round_trips(lattice, "the end", [x[:-1] if i == k else x for i, x in enumerate(arrays)], at_once)
            assert not S.round_trips(lattice, "the enc", arrays, at_once) and S.round_trips(lattice, "the end", arrays, at_once)
        swapped = [np.concatenate((arrays[0], arrays[1][:1])), arrays[1][1:], *arrays[2:]]  # the same pieces in all, but not the same texts
        assert not S.round_trips(lattice, "the end", swapped, at_once)


def test_other_normalizers_are_refused(tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=FILE).serialized_model_proto()
    S.check_normalizer(model)
    own = bytes([10, 8]) + b"identity" + bytes([18, 0, 24, 1, 32, 0, 50, 0])
    assert model.count(own) == 1
    for changed, why in ((own.replace(bytes([32, 0]), bytes([32, 1])), "white space"), (own.replace(bytes([24, 1]), bytes([24, 0])), "white space"), (own.replace(bytes([18, 0, 24, 1]), bytes([18, 2, 65, 65])), "maps")):
        (tmp_path / "other.model").write_bytes(model.replace(own, changed))
        with pytest.raises(ValueError, match=why):
            S.check_normalizer((tmp_path / "other.model").read_bytes())


def test_ids_of_other_types(spark):
    got = S.encode_documents(spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string"), FILE).collect()
    assert {(r.doc_id, r.round_trip) for r in got} == {("a", True), (None, True)}
