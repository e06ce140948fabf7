import pyarrow as pa

from skimmer.llm import textvec


def test_words_follow_python_splitting(odd_texts):
    h, at = textvec.words(pa.array(odd_texts))
    names = {}
    for i, text in enumerate(odd_texts):
        words = textvec.word_bytes(text)
        assert at[i + 1] - at[i] == len(words)
        for w, x in zip(words, h[at[i] : at[i + 1]].tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_pieces_do_not_change_hashes(odd_texts, monkeypatch):
    whole = textvec.words(pa.array(odd_texts))
    monkeypatch.setattr(textvec, "PIECE_BYTES", 64)
    small = textvec.words(pa.array(odd_texts))
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()


def test_windows_match_shingles(odd_texts):
    column = pa.array(odd_texts).slice(3)
    h, at = textvec.words(column)
    w, first = textvec.windows(h, at, 5)
    names = {}
    for i, text in enumerate(odd_texts[3:]):
        shingles = textvec.shingle_bytes(textvec.word_bytes(text), 5)
        assert first[i + 1] - first[i] == len(shingles)
        for s, x in zip(shingles, w[first[i] : first[i + 1]].tolist()):
            assert names.setdefault(s, x) == x
    assert len(set(names.values())) == len(names)


def test_empty_column():
    assert textvec.words(pa.array([], pa.string()))[1].tolist() == [0]
    assert textvec.words(pa.array([None], pa.string()))[1].tolist() == [0, 0]
