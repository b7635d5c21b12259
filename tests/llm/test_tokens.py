"""The BPE transducer against the tiktoken library, and streaming both ways."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from helpers import TEXTS, documents, no_documents

from waypoint.llm import bpe
from waypoint.llm.common import tokenizer


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(tokenizer()[0])
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts_encode_as_the_library_does(both):
    own, library = both
    draw = random.Random(3)
    bits = ["abcdefghij", "the  ing\n\t", "éèñ😀中文ü", "​\x85\xa0 a1", "aaaa", "0123456789", ".,-_=!@#'s"]
    names = [t for t in own.pieces.transducer.ranks if len(t) < 12]
    texts = ["".join(draw.choice(draw.choice(bits)) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += [b"".join(draw.choice(names) for _ in range(3)).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["a" * 20000, " " * 20000, "ab" * 9000, "x" + "é" * 9000, "".join(draw.choice("etaoin") for _ in range(20000)), *[t or "" for _, t in TEXTS]]
    for text in texts:
        packed = own.encode(text)
        assert ids(packed) == library.encode_ordinary(text), text[:80]
        assert own.decode(packed) == text


def test_tokens_come_out_of_a_stream_before_its_end(both):
    own, _ = both
    draw = random.Random(4)
    text = ("".join(draw.choice("etaoinshr") for _ in range(6000))).encode()
    stream, out, early = bpe.EncodeStream(own.pieces.transducer), [], 0
    for at in range(0, len(text), 100):
        out.append(stream.feed(text[at : at + 100]))
        early += len(out[-1]) // 4
        assert len(stream.lasts) < 300  # bounded lookahead
    out.append(stream.end())
    assert b"".join(out) == own.pieces.transducer.encode(text) and early > 1000


def test_utf8_stream_equals_decoding_at_once():
    draw = random.Random(5)
    for _ in range(2000):
        data = bytes(draw.randrange(256) if draw.random() < 0.3 else draw.choice("aé中😀".encode()) for _ in range(30))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            size = draw.randint(1, 5)
            out, at = out + stream.feed(data[at : at + size]), at + size
        assert out + stream.end() == data.decode("utf-8", "replace")


def test_table_round_trip(spark, both):
    _, library = both
    path, pattern = tokenizer()
    rows = bpe.tokenize(documents(spark), path, pattern, outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert "lang" in rows.columns and "text" not in rows.columns
    back = bpe.detokenize(rows, path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k or 0, t or "") for k, t in TEXTS)
    for r in back:
        packed = struct.pack(f"<{r.n_tokens}I", *library.encode_ordinary(r.text))
        assert (r.ids, r.ids_sha256, r.decoded_sha256) == (packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert bpe.tokenize(no_documents(spark), path, pattern).count() == 0


def test_decoded_digest_comes_through_the_stream_decoder(monkeypatch):
    fed, feed = [], bpe.Utf8Stream.feed
    monkeypatch.setattr(bpe.Utf8Stream, "feed", lambda self, data: fed.append(bytes(data)) or feed(self, data))
    path, pattern = tokenizer()
    work = bpe.Codec(bpe.load_ranks(path), pattern)
    work.CHUNK = 3  # cuts characters apart
    for text in ("", "Größe, naïve café, 😀 and \x85 odd \u200b signs 漢字" * 5):
        row = bpe._row(work, text, ("decoded_sha256",))
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert b"".join(fed) == text.encode()
