import numpy as np
import pyarrow as pa

from voxstars.llm import texts


def test_slices_words_and_hashes_of_a_column():
    column = pa.chunked_array([pa.array(["One two", None, "", " \t x!y "]), pa.array(["été", "z" * 3_000_000 + " tail"])])
    data, offsets = texts.text_bytes(column)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in column.to_pylist()]
    starts, ends = texts.words(data, offsets)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for t in column.to_pylist() for w in (t or "").encode().split()]
    hashes = texts.token_hashes(data, starts, ends)
    alone = [texts.token_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in found]
    assert hashes.tolist() == alone and len(set(alone)) == len(set(found))
    rows = []
    for first, part, at in texts.slices(data, offsets, 10):
        rows += [part[a:b].tobytes() for a, b in zip(at, at[1:])]
        assert first + len(at) - 1 == len(rows)
    assert rows == [(t or "").encode() for t in column.to_pylist()]


def test_pieces_are_letters_or_signs():
    data = np.frombuffer("Ab1,!! x".encode(), np.uint8)
    starts, ends = texts.pieces(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"Ab1", b",!!", b"x"]


def test_nothing():
    data, offsets = texts.text_bytes(pa.array([], pa.string()))
    assert len(data) == 0 and list(texts.slices(data, offsets)) == []
    assert [len(x) for x in texts.words(data, offsets)] == [0, 0]
