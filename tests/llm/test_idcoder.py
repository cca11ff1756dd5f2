"""The coder's bytes stay as they were, and words found before are not written again."""

import hashlib

import numpy as np

from tapeloom.llm import idcoder, tokenids


def test_coded_bytes_are_fixed():
    ids = (np.arange(idcoder.BLOCK * 3) ** 2 % 977).astype(np.uint16)
    share = idcoder.order_zero(np.bincount(ids, minlength=1 << 16))
    coded = idcoder._encode_blocks(ids.reshape(3, -1).T.copy(), np.full(3, idcoder.BLOCK), share)
    assert hashlib.sha256(b"".join(c.tobytes() for c in coded)).hexdigest()[:16] == "d9245785f76f6540"


def test_words_found_before_are_not_written_again():
    class Counted(tokenids.Memory):
        writes = 0

        def __setitem__(self, key, value):
            self.writes += 1
            super().__setitem__(key, value)

    words = tokenids.WordIds(tokenids.default_tokenizer())
    words.words = Counted(100)
    first = words.batch(["some plain words, größer als été 12"])
    before = words.words.writes
    again = words.batch(["some plain words, größer als été 12"])
    assert before and words.words.writes == before and all((a == b).all() for a, b in zip(first, again))


def test_last_blocks_of_any_length_and_lone_ids_come_back():
    rng = np.random.default_rng(7)
    for n in (1, 31, 33, idcoder.BLOCK - 1, idcoder.BLOCK + 31, idcoder.BLOCK * 2 + 33):
        for ids in (rng.integers(0, 1 << 16, n), np.minimum(rng.zipf(1.3, n), 65535), np.full(n, 65535), np.zeros(n, int)):
            ids = ids.astype(np.uint16)
            assert (idcoder.read_segment(idcoder.write_segment([1], [n], ids))[2] == ids).all()


def test_new_words_go_to_the_model_together():
    """One call of the library for thousands of new words; before, one call each."""
    words = tokenids.WordIds(tokenids.default_tokenizer())
    calls, bare = [], words.bare

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return bare.encode_batch_fast(texts, **options)

    words.bare = Counted()
    rng = np.random.default_rng(3)
    text = " ".join("".join(map(chr, rng.integers(97, 123, size))) for size in rng.integers(1, 40, 3000)) + " été größe, x-y_z (12)"
    ids, _ = words.batch([text])
    assert len(calls) == 1 and ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    words.last[:] = False  # a model that marks no last pieces
    words.words.clear()
    assert words.batch([text])[0].tolist() == ids.tolist() and len(calls) == 1


def test_words_that_differ_late_stay_apart(monkeypatch):
    monkeypatch.setattr(tokenids, "run_hashes", lambda b, start, end: (end - start).astype(np.uint64))
    words = tokenids.WordIds(tokenids.default_tokenizer())
    for text in ("abcdefghijklmnopqa abcdefghijklmnopqb", "abcdefgh abcdefgi", "abcdefghi abcdefghj", "a b"):
        assert words.batch([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_ids_read_back_in_any_width(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, None), (3, "another, longer text")], "doc_id long, text string")
    segments = tokenids.write_ids(docs)
    narrow, wide = ({r.doc_id: r.ids for r in tokenids.read_ids(segments, *w).collect()} for w in ((), (4,)))
    assert len(narrow) == 3 and {d: np.frombuffer(b, "<u2").tolist() for d, b in narrow.items()} == {d: np.frombuffer(b, "<u4").tolist() for d, b in wide.items()}
