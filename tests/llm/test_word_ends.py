"""Texts whose words are marked before the library merges them get the ids that the vocabulary's own steps give."""

import random
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import word_ends

PATH = public_tokenizers.path("word_bpe_49k.json")
COMMON = [*"aAbstSTmdrevlLZ’'\"!.,-_1 2\n\t\r\x0b\x0c\x00\x1c\x7f\x85\xa0éÉßÑ×²½ªµſŁΣςІ٣“—…€", "'s", "'re", "'LL", "'ve", "''", " '"]
RARE = ["́", "̧", "漢", "한", "한", "İ", "K", "Ω", "\U0001f600", "　", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "é"]


@pytest.fixture(scope="module")
def whole():
    return word_ends.WholeTexts(PATH)


@pytest.fixture(scope="module")
def library():
    tk = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in tk.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


def test_every_character_against_the_library(whole, library):
    every = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    texts = [x.encode() for c in every for x in (c, f"a{c}b {c}{c}1{c}2 !{c}'s")]
    assert whole(texts) == library(texts)
    assert len({*word_ends.symbols().tolist()}) == 512


@pytest.mark.parametrize(("parts", "covered"), [(COMMON, True), ("stmdrevl'' aé!", True), (COMMON + RARE, False)])
def test_made_texts_against_the_library(whole, library, parts, covered):
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))).encode() for _ in range(20_000)]
    assert whole(texts) == library(texts)
    missed = [t for t, m in zip(texts, whole.mark(texts), strict=True) if m is None]
    assert not missed if covered else 0 < len(missed) < len(texts)


def test_texts_at_the_edges(whole, library):
    for texts in ([], [b""], [b"", b""], [b"'", b"'s", b"a'", b"'r", b"'re", b"s", b"", b"e"], [b"long words  " * 100_000, b"a" * 20_000]):
        assert whole(texts) == (library(texts) if texts else [])


@pytest.mark.parametrize("raw", [b"a\xff", b"\xc3", b"\xe2\x80", b"a\xa9b", b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80"])
def test_malformed_texts_raise(whole, raw):
    with pytest.raises(UnicodeDecodeError):
        whole([b"ok", raw, b"e\xc3\xa9"])


def test_other_vocabularies_are_used_as_they_are():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's é. 12", "", "<|endoftext|> x"]
    assert word_ends.WholeTexts(path).marked is None
    assert word_ends.WholeTexts(path)([t.encode() for t in texts]) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_documents_take_less_time_than_by_the_vocabularys_own_steps(whole, library, monkeypatch):
    """The check's budget needs about half; 0.4 was measured."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"][:1500].to_pylist()]
    took = []
    for encode in (whole, library):
        encode(texts[:50])
        began = time.process_time()
        ids = encode(texts)
        took.append((time.process_time() - began, ids))
    assert took[0][1] == took[1][1]
    assert took[0][0] < 0.65 * took[1][0]
    assert not any(m is None for m in whole.mark(texts))
