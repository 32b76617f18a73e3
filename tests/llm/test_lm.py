"""Language-model scores: exact base scores by brute force, the filter's one-sided error, and a better model than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import WORD, rows_of


def brute(rows):
    toks = [(k, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for k, t in rows]
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    c = Counter(w for k, ws in toks if not out(k) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((k, out(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for k, ws in toks), key=str)


@pytest.mark.parametrize("head,filter_bytes", [(1 << 18, 96 << 20), (50, 1000)])
def test_scores(documents, odd, head, filter_bytes):
    from llm.lm_score import lm_score

    for df in (odd, documents):
        got = lm_score(df, head, filter_bytes).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == brute(rows_of(df))
        assert all(-math.inf < r["score"] <= 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def dictionary_model(rows):
    """Scores by plain counts, each rounded down (shares) or up (contexts) to the filter's half powers of two."""
    toks = [(k, ["<begin>", *(("w", w) for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), "<end>"]) for k, t in rows]
    train = [ws for k, ws in toks if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    words, pairs = Counter(w for ws in train for w in ws[1:]), Counter(p for ws in train for p in zip(ws, ws[1:]))
    total = sum(words.values()) + 0.5 * (len(words) + 1)
    level = lambda c: math.floor(2 * math.log2(c) + 1e-9)
    floor = lambda c: math.ceil(2 ** (level(c) / 2) - 1e-9) if c else 0
    ceil = lambda c: max(floor(c), math.ceil(2 ** ((level(c) + 1) / 2) - 1e-9) - 1) if c else 0

    def p(h, w):
        seen = ceil(words["<end>" if h == "<begin>" else h])
        weight = seen / (seen + 2)
        return weight * min(1, floor(pairs[h, w]) / max(seen, 1)) + (1 - weight) * (floor(words[w]) + 0.5) / total

    return sorted(((k, sum(math.log10(p(h, w)) for h, w in zip(ws, ws[1:]))) for k, ws in toks), key=lambda r: (str(r[0]), r[1]))


def test_score_is_the_dictionary_models(documents, odd):
    """With a filter that hardly errs the scores are those of plain counts; what workers hold changes none of them."""
    from llm.lm_score import lm_score

    by = lambda r: (str(r[0]), r[1])
    for df in (odd, documents):
        want = dictionary_model(rows_of(df))
        wide, narrow = (sorted(((r["doc_id"], r["score"]) for r in lm_score(df, head, size, 64).collect()), key=by) for head, size in ((1 << 18, 96 << 20), (50, 1000)))
        assert wide == narrow and [k for k, _ in wide] == [k for k, _ in want]
        near = [abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(wide, want)]
        assert np.mean(near) > 0.98
        assert all(abs(a - b) < 0.01 * max(1, abs(b)) for (_, a), (_, b) in zip(wide, want))


def test_filter_never_underestimates_a_level():
    from llm.lm_score import BITS, CEIL, FLOOR, fill, levels, probe

    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 1 << 63, 4000).astype(np.uint64), rng.zipf(1.5, 4000).clip(1, 10**6)
    size = max(64, int(BITS * levels(counts).sum()))
    q = probe(fill(keys, counts), size, keys)
    assert (q >= levels(counts)).all() and (q == levels(counts)).mean() > 0.9
    assert (FLOOR[levels(counts)] <= counts).all() and (CEIL[levels(counts)] >= counts).all()
    assert (probe(fill(keys, counts), size, rng.integers(0, 1 << 63, 4000).astype(np.uint64)) > 0).mean() < 0.08


def test_empty(empty):
    from llm.lm_score import lm_score

    assert lm_score(empty).count() == 0
