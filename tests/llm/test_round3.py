"""Findings of round 3 about the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from notewright.llm import jaccard, sentspans, spiece


def test_filter_has_a_slot_for_each_token_at_any_size():
    most = jaccard.components.__kwdefaults__ or dict(zip(jaccard.components.__code__.co_varnames[1:6], jaccard.components.__defaults__, strict=True))
    for chars in (10**9, 10**10, 4 * 10**10):
        assert 2 ** jaccard.filter_size(chars, most["most_bits"]) >= chars // 5


def test_filter_file_tells_shared_tokens(spark):
    """Over several chunks; each worker maps the file by its name."""
    bits, h = 18, np.arange(1, 4001, dtype=np.int64) * 7_919_777
    twice = np.concatenate([h, h[::3]])
    slots, counts = np.unique(jaccard._slots(twice, bits), return_counts=True)
    rows = []
    for c in np.unique(slots >> 16):
        at = slots >> 16 == c
        low = (slots[at] & 0xFFFF).astype(np.uint16)
        rows.append((int(c), bytearray(low.tobytes()), bytearray(low[counts[at] > 1].tobytes())))
    name = jaccard.filter_file(spark.createDataFrame(rows, "chunk long, ones binary, twos binary"), bits)
    order = spark.sparkContext.broadcast(jaccard.Order(name, bits, np.zeros(0, np.int64), np.zeros(0)))
    got = spark.sparkContext.parallelize([0, 1], 2).map(lambda i: order.value.look(h)[0].tolist()).collect()
    want = np.isin(jaccard._slots(h, bits), slots[counts > 1]).tolist()
    assert got == [want, want]
    assert not all(want)


def test_runs_are_kept_in_lists_so_that_texts_are_cut_once():
    texts = [" ".join(f"w{i % 40}." for i in range(90)), None or "", "One two. Three four."]
    part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([None, None, "k"]), pa.array(texts)], ["did", "tk", "text"])
    (_, rows, places, h), = sentspans._hashed([part], 3, 25)
    (got,) = sentspans._all_runs(3, 25)([part])
    assert [len(x) for x in got.column("place").to_pylist()] == np.bincount(rows, minlength=3).tolist()
    assert sum(got.column("h1").to_pylist(), []) == h[:, 0].tolist()
    assert sum(got.column("place").to_pylist(), []) == places.tolist()


def test_words_with_other_marks_behind_are_walked_once():
    p = spiece.load()
    e = spiece.Encoder(p)
    text = "ofx, ofx. été### ofx\n12ofx 7"
    (got,) = e.encode([text])
    assert set(e.ids) == {"▁ofx", ",", ".", "▁été", "###", "\n", "12", "ofx", "▁7"}
    assert spiece.decode_ids(got.tolist(), p) == text


def test_a_piece_of_letters_and_others_keeps_words_whole():
    """Also letters outside of the Latin range count as others."""
    for piece in ("a.", "aж", "1a"):
        plain = {"▁": 1, **{c: i for i, c in enumerate("".join(dict.fromkeys("ab.ж1")), 2)}, piece: 9}
        names = ["?", *plain, "-", "-"][:10]
        p = spiece.Pieces(names, [0.0] * 9 + [1.0], plain, None, 0, True, True)
        assert p.words is spiece.MARKED
        (got,) = spiece.Encoder(p).encode(["b" + piece])
        assert got.tolist()[-1] == 9
