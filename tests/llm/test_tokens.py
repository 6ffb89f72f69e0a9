"""Encodings against the tokenizers library, and the round trip."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.tokenizer_source(PATH))


def numbers(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


TEXTS = [
    "", " ", "  a", "a  ", "a \n b", "'s's 'll", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "<|endo", "a" * 3000, "ab" * 2000,
    " " * 500 + "x", "the" * 50, "\r\n\r\n x\t\ty", "\x85a 　 b  c", "\x1c\x1d x", "Ⅷ½² ٣x", "中文字 混 ab", "😀😀 é é",
]


def test_known_texts(encoder):
    assert [numbers(x) for x in encoder.encode(TEXTS)] == [x.ids for x in LIBRARY.encode_batch(TEXTS, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\tabcst'é1"), max_size=60))
def test_any_text(text):
    encoder = test_any_text.__dict__.setdefault("encoder", bpe.Encoder(bpe.tokenizer_source(PATH)))
    ids = numbers(encoder.encode([text])[0])
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "TRIE_NODES", 20)
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "then", "there", "thereof", "cat", "Häuser,", "cats."]) for _ in range(9)) for _ in range(50)]
    small = bpe.Encoder(bpe.tokenizer_source(PATH))
    assert [numbers(small.encode([t])[0]) for t in texts] == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_a_share_of_the_caches(monkeypatch):
    """Less is held, and the ids are the library's."""
    for name, most in (("CACHED_PIECES", 400), ("TRIE_NODES", 400), ("KNOWN_PAIRS", 400)):
        monkeypatch.setattr(bpe, name, most)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    held = {}
    for share in (1.0, 0.1):
        encoder = bpe.Encoder(bpe.tokenizer_source(PATH), share)
        most = [0, 0, 0]
        for text, wanted in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
            assert numbers(encoder.encode([text])[0]) == wanted.ids
            most = list(map(max, most, [len(encoder.pieces.recent), len(encoder.trie.last), len(encoder.vocabulary.known)]))
        held[share] = most
    assert all(small < large / 2 for small, large in zip(held[0.1], held[1.0]))


@pytest.mark.parametrize("sign", ["\n", " ", "=", "a", "é", "xy"])
def test_a_run_of_a_million(encoder, sign):
    """The trie keeps the first bytes of the run only; the ids are the library's on a shorter run, and decode to the text on all of it."""
    nodes = len(encoder.trie.last)
    long = "word" + sign * (1_000_000 // len(sign))
    assert bpe.decoded(encoder.bytes, encoder.encode([long])[0]) == long
    assert len(encoder.trie.last) <= nodes + 2 * bpe.DEEP
    assert numbers(encoder.encode([long[:20_000]])[0]) == LIBRARY.encode(long[:20_000], add_special_tokens=False).ids


def test_the_trie_starts_anew_within_a_step(monkeypatch):
    monkeypatch.setattr(bpe, "TRIE_NODES", 500)
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 9, 200]))) for _ in range(2000))
    small = bpe.Encoder(bpe.tokenizer_source(PATH))
    assert numbers(small.encode([text])[0]) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(small.trie.last) <= 500 + bpe.DEEP + 1


def test_words_met_before_are_not_worked_out_again(monkeypatch):
    encoder = bpe.Encoder(bpe.tokenizer_source(PATH))
    asked, encode = [], encoder.trie.encode
    monkeypatch.setattr(encoder.trie, "encode", lambda words: asked.append(words) or encode(words))
    texts = ["Häuser vergeber erone", "Häuser vergeber, erone.\nvergeber\n\n  \nHäuser erone!", "\nerone \n vergeber,"]
    assert [numbers(encoder.encode([t])[0]) for t in texts] == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert sorted(asked[1]) == ["\n", "\n\n  ", "!", ",", ".", "vergeber"]
    assert sorted(asked[2]) == [" \n", "erone"]


def test_a_worker_knows_each_entry_once():
    """Vocabulary and decoder share their bytes, and nodes are few: executors hold two workers beside their heap."""
    encoder = bpe.Encoder(bpe.tokenizer_source(PATH))
    assert all(encoder.bytes[i] is t for t, i in encoder.vocabulary.ids.items())
    assert encoder.bytes == bpe.token_bytes(bpe.tokenizer_source(PATH))
    r = random.Random(3)
    for _ in range(4):
        encoder.encode([" ".join("".join(r.choices("abcdefghij", k=12)) for _ in range(6000))])
        assert len(encoder.trie.last) <= 100_000 + bpe.DEEP + 1


def test_frames(spark):
    texts = [None, *TEXTS, TEXTS[3], TEXTS[3]]
    rows = [(i if i != 2 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    source = bpe.tokenizer_source(PATH)
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, source).collect()), key=str) == sorted(want, key=str)
    arrays = bpe.ids_array(bpe.encode(docs, source))
    assert {r.doc_id: r.ids for r in arrays.collect()}[4] == LIBRARY.encode(texts[4], add_special_tokens=False).ids
    assert bpe.digests(docs.where("false"), source).count() == 0


def test_decoding_any_ids(spark):
    tokens = [(1, struct.pack("<3I", 128, 200, 65)), (2, None), (3, b""), (4, struct.pack("<2I", 50256, 0)), (5, struct.pack("<1I", 60000))]
    done = bpe.decode(spark.createDataFrame(tokens, "doc_id long, ids binary"), bpe.tokenizer_source(PATH))
    got = {r.doc_id: r.text for r in done.collect()}
    assert got[1] == LIBRARY.decode([128, 200, 65], skip_special_tokens=False)
    assert (got[2], got[3], got[4], got[5]) == ("", "", "<|endoftext|>!", "")
