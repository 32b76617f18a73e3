"""Encoding, packing and id files: round trips against the library and a plain search."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
STRANGE = ["it's we'll DON'T 'sx ''s", "a_b__c 12,345.67 ²½", "ﬁ Ａ İstanbul ǅ ŉ ª º µ", "ΑΣ ΣΑΣ", "<|endoftext|> x <|startoftext|>", "\x00\x1c\x1f\x85\xa0  z", "é é ñ", "日本語 テスト", "🙂🙂 !!!??", "a" * 5000, "", " \n\t "]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def truth(documents, odd):
    t = library()
    return {id(df): [(k, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for k, x in rows_of(df)] for df in (documents, odd)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(documents, name):
    from llm.encode import Encoder, tokenizer_text
    from tokenizers import Tokenizer

    texts = STRANGE + [t for _, t in rows_of(documents)]
    enc, lib = Encoder(tokenizer_text(public_tokenizers.path(name))), Tokenizer.from_file(public_tokenizers.path(name))
    assert enc.by_word == (name == "word_bpe_49k.json")
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want


def test_a_slice_costs_its_own_words():
    """However many words are met before, a slice looks up its own and goes through no more; common ones outlive a full cache."""
    from llm.encode import Encoder, tokenizer_text

    class Held(dict):
        def keys(self):
            raise AssertionError("the whole cache is gone through")

        __iter__ = items = values = keys

    enc, lib = Encoder(tokenizer_text(PATH)), library()
    for cache in (enc.words_met, enc.runs_met):
        cache.limit, cache.young, cache.old = 12, Held(), Held()
    for i in range(9):
        texts = [f"some words, (others) it's x{i}", "others\tsome x_1<b> new", "a<| b", None, " \n ", f"{'z' * i} y{i}"]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert "words," in enc.runs_met.young and len(enc.runs_met.young) <= 24 and len(enc.words_met.young) <= 24


def test_caches_are_bounded_in_bytes():
    """Many runs that are met once, long ones too, take no more than two generations of bytes and what one call brings."""
    from llm.encode import Encoder, tokenizer_text

    enc, lib = Encoder(tokenizer_text(PATH)), library()
    caches = (enc.words_met, enc.runs_met)
    for cache in caches:
        cache.limit = 100_000
    for i in range(30):
        texts = [f"common {'xy' * 200}{'z' * i}{'q' * j}, word{'ab' * i}{'c' * j}" for j in range(20)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        for cache in caches:
            assert sum(len(k) + len(v) for part in (cache.young, cache.old) for k, v in part.items()) <= 3 * 100_000


def test_other_steps_drop_the_encoder():
    """Workers live on from stage to stage: slices of the encoder's own step keep it, those of another step give it back."""
    import weakref
    from types import SimpleNamespace

    import pyarrow as pa

    from llm.encode import encoder, text_slices, tokenizer_text
    from llm.kernel import slices

    batch = pa.RecordBatch.from_pydict({"text": ["some text"]})
    shared = SimpleNamespace(value=tokenizer_text(PATH))
    held = weakref.ref(encoder(shared))
    list(text_slices(iter([batch])))
    assert held() is not None and encoder(shared) is held()
    list(slices(iter([batch])))
    assert held() is None


def test_best_fit_takes_the_tightest_window():
    from llm.packing import best_fit

    rng = np.random.default_rng(1)
    for n in (1, 5, 400):
        lengths = sorted(rng.integers(1, 65, n).tolist(), reverse=True)
        room, want = [], []
        for x in lengths:
            fit = min((r for r in room if r >= x), default=None)
            want.append(fit if fit is not None else 64)
            if fit is not None:
                room.remove(fit)
            room.append((fit or 64) - x)
        to, at = best_fit(lengths, 64)
        assert [64 - a for a in at] == want


@pytest.mark.parametrize("window", [4096, 100])
def test_packing(documents, odd, truth, window):
    from llm.packing import pack, sequences

    for df in (documents, odd):
        rows = pack(df, PATH, window=window, with_ids=True)
        got, by_doc, by_seq = rows.collect(), defaultdict(list), defaultdict(list)
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"])
            by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], list(np.frombuffer(r["ids"], "<u4"))))
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        for ps in by_seq.values():
            at = 0
            for o, n in sorted(ps):
                assert o == at
                at += n
            assert at <= window
        want = Counter((k, i, tuple(ids[i : i + window])) for k, ids in truth[id(df)] for i in range(0, len(ids), window))
        assert Counter((k, s, tuple(ids)) for (k, _), ps in by_doc.items() for s, ids in ps) == want
        assert sum(r["n_tokens"] for r in sequences(rows, window=window).collect()) == sum(len(i) for _, i in truth[id(df)])


@pytest.mark.parametrize("shard_bytes", [24 << 20, 100_000])
def test_id_files(documents, odd, truth, shard_bytes):
    from llm.id_files import Shard, write_ids

    for df in (documents, odd):
        files = write_ids(df, PATH, shard_bytes=shard_bytes)
        got = files.read().collect()
        rows, at, want = sorted(truth[id(df)], key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
        for k, ids in rows:
            want.append((k, len(ids), crc(ids)))
            at += len(ids)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
        ends = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
        assert [s for s, _, _ in ends] == np.concatenate([[0], np.cumsum([n for _, n, _ in ends])[:-1]]).tolist()
        assert [k for _, _, k in ends] == [k for k, _ in rows]
        for k in (6, 7, 150):
            assert Counter(tuple(i) for i in files.get(k)) == Counter(tuple(ids) for d, ids in rows if d == k)
        assert files.get(10**9) == [] and (Shard(files.shards[0][1]).find(np.arange(10**6, 10**6 + 5000)) == -1).all()


def test_perfect_hash_is_minimal():
    from llm.id_files import PerfectHash

    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


def test_empty(empty):
    from llm.id_files import write_ids
    from llm.packing import pack

    assert pack(empty, PATH).count() == 0 and write_ids(empty, PATH).read().count() == 0
