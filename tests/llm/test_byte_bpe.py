"""Byte-level BPE held against the library, and decoding against the texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
STRANGE = ["it's we'll DON'T 'sx ''s 'r'e", " \t\n  x   y \n\n ", "a_b__c 12,345.67 ²½", "ﬁ Ａ İ ǅ ŉ ª º µ", "<|endoftext|> x", "\x00\x1c\x1f\x85\xa0  z", "é é ñ", "日本語 テスト", "🙂🙂 !!!??", "", "?" * 3001, " " * 5000, "a" * 20011, "ab" * 9000 + "'s", "xyzzy" * 3000]


@pytest.fixture(scope="module")
def ranks():
    from llm.byte_bpe import read_ranks

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small(ranks):
    """A codec whose leaves are so small that nearly all is joins."""
    from llm import byte_bpe

    class Small(byte_bpe.Codec):
        def tree(self, raw):
            half = len(raw) // 2
            return self.merge(raw) if half == 0 else self.join(self.tree(raw[:half]), self.tree(raw[half:]))

        def matches(self, text):
            half = len(text) // 2
            return [self.findall(text)] if half == 0 else self.seam(self.matches(text[:half]), self.matches(text[half:]))

    return Small(ranks, public_tokenizers.PATTERN)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["'", "'re", "'ll", "s", " ", "  ", "\n", "\t", "a", "the", "ing", "1", "22", "!", "é", "漢", "🙂", " ", "aaaa", "=="]), st.text(max_size=4).filter(lambda x: x.isprintable())), max_size=24).map("".join))
def test_joins_are_the_library(small, library, text):
    assert ids_of(small.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehilnorst", min_size=1, max_size=300), st.integers(1, 299))
def test_any_split_joins_to_the_same(small, library, word, cut):
    raw = word.encode()
    want = library.encode_ordinary(word)
    if raw not in small.ranks:
        assert small.merge(raw) == small.merge_many(raw) == want
        if cut < len(raw):
            assert small.join(small.merge(raw[:cut]), small.merge(raw[cut:])) == want


def test_strange_and_long(ranks, library):
    from llm.byte_bpe import Codec

    own = Codec(ranks, public_tokenizers.PATTERN)
    long = " ".join(STRANGE) * 3
    for text in [*STRANGE, long]:
        ids = own.encode(text)
        assert ids_of(ids) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_character(ranks, library):
    from llm.byte_bpe import Codec

    own = Codec(ranks, public_tokenizers.PATTERN)
    for c in [*range(0x3000), *range(0x1E000, 0x1F000, 7), *range(0xA000, 0xB000, 3)]:
        text = f"a{chr(c)}a 1{chr(c)}1 {chr(c)} {chr(c)}!"
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def test_tables(documents, odd, empty, ranks, library):
    from llm.byte_bpe import decode, encode, round_trip

    pattern = public_tokenizers.PATTERN
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for df in (documents, odd):
        want = [(k, library.encode_ordinary(x or ""), (x or "").encode()) for k, x in rows_of(df)]
        digest = Counter((k, len(i), sha(np.array(i, "<u4").tobytes()), sha(raw)) for k, i, raw in want)
        assert Counter(tuple(r) for r in round_trip(df, ranks, pattern).collect()) == digest
        ids = encode(df, ranks, pattern)
        assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in ids.collect()) == Counter((k, len(i), np.array(i, "<u4").tobytes()) for k, i, _ in want)
        assert Counter((r["doc_id"], bytes(r["decoded"])) for r in decode(ids, ranks, pattern).collect()) == Counter((k, raw) for k, _, raw in want)
    assert round_trip(empty, ranks, pattern).count() == 0
