import hashlib
import random

import numpy as np
import public_tokenizers
from llm_data import SMALL, corpus, docs

from review_trust.llm import bpe


def enc():
    return bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


def test_equals_library_and_round_trip(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in bpe.digests(docs(spark, rows)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = enc().encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        digests = [hashlib.sha256(x).hexdigest() for x in (raw, (text or "").encode())]
        want.append((doc_id, len(ids), *digests))
    assert got == sorted(want, key=str)


def test_cuts_change_nothing():
    rng = random.Random(1)
    alphabet = ["a", "Z", "é", "漢", " ", "  ", "\n", "\t", "\x1c", "\u3000", "'s", "1", "!", "\u200b", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 2, 40)) for _ in range(rng.randrange(120)))
        whole = enc().encode_ordinary(text)
        parts = list(bpe.pieces(text, 16))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc().encode_ordinary(p)] == whole
        assert bpe.encode_text(enc(), text).tolist() == whole


def test_very_long_texts():
    for text in ("word " * 100_000, "x" + " " * 300_000 + "y", "\n" * 300_000, "q" * 100_000, " a" + " " * 1_500):
        ids = bpe.encode_text(enc(), text)
        assert enc().decode_bytes(ids.tolist()) == text.encode()
    for text in ("x" + " " * 5_000 + "y", "\n" * 5_000, " " * 1_000 + "a", "a" + "\t" * 1_001):
        assert bpe.encode_text(enc(), text).tolist() == enc().encode_ordinary(text)


def test_another_pattern_gets_whole_texts(spark):
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+(?!\S)|\s+"
    own = bpe.encoding(public_tokenizers.path(bpe.RANKS), pattern)
    texts = ["a!!" + "\n" * 1_500 + "b", "word. " * 20_000 + "!" * 30 + "\n" * 40, ""]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, list(enumerate(texts))), pattern=pattern).collect()}
    assert [np.frombuffer(got[i], "<u4").tolist() for i in range(3)] == [own.encode_ordinary(t) for t in texts]


def test_empty_table_and_ids(spark):
    assert bpe.digests(docs(spark, [])).count() == 0
    rows = bpe.encode(docs(spark, list(enumerate(SMALL)))).collect()
    assert [r.n_tokens * 4 for r in rows] == [len(r.ids) for r in rows]
    assert bpe.decode(bpe.encode(docs(spark, [(1, None)]))).first().decoded == b""
