"""Word-piece counts against a plain greedy search; classifiers by held-out accuracy."""

import numpy as np
import pytest

from tests.llm.conftest import WORD, rows_of


def greedy(word, pieces, most):
    s, n, i = b" " + word, 0, 0
    while i < len(s):
        j = next((j for j in range(min(len(s), i + most), i, -1) if s[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def brute(rows, pieces):
    most = max(map(len, pieces))
    words = [[w.encode() for w in WORD.findall(t or "")] for _, t in rows]
    known = {w: greedy(w, pieces, most) for ws in words for w in ws}
    return sorted(((k, len(ws), sum(known[w] for w in ws)) for (k, _), ws in zip(rows, words)), key=str)


def test_token_counts(documents, odd, empty):
    import public_tokenizers

    from llm.encode import tokenizer_text
    from llm.token_counts import byte_level_pieces, token_counts

    pieces = byte_level_pieces(tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
    for df in (odd, documents):
        got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(df, pieces).collect()), key=str)
        assert got == brute(rows_of(df), set(pieces))
    assert token_counts(empty, pieces).count() == 0


def test_links_pop_pieces_as_greedy_search_does():
    import pyarrow as pa

    from llm.kernel import Words
    from llm.token_counts import Automaton

    rng = np.random.default_rng(3)
    for _ in range(40):
        pieces = {bytes(rng.choice(list(b"ab"), rng.integers(1, 6))) for _ in range(8)} | {b" " + bytes(rng.choice(list(b"ab"), rng.integers(0, 4))) for _ in range(4)}
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 30), p=[0.49, 0.49, 0.02])) for _ in range(60)]
        got = Automaton(sorted(pieces)).counts(Words(pa.array([" ".join(words)])))
        assert got.tolist() == [greedy(w.encode(), pieces, 9) for w in words]


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers(spark, name, odd, empty):
    from llm.quality import score_quality
    from llm.shared import fold
    from llm.toxicity import score_toxicity

    score = {"quality": score_quality, "toxic": score_toxicity}[name]
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = score(docs, labels).join(labels, "doc_id").where(fold() == 0).select("score", "predicted", name).toPandas()
    a, b = found[found[name] == 1]["score"].to_numpy(), found[found[name] == 0]["score"].to_numpy()
    assert ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) > 0.95
    assert (found["predicted"] == found[name]).mean() > 0.93
    out = score(odd.withColumn("score", odd.bucket), labels)
    assert out.count() == odd.count() and out.columns == ["doc_id", "text", "source", "bucket", "score", "predicted"]
    assert score(odd, labels.limit(0)).where("score between 0 and 1").count() == odd.count()
    assert score(empty, labels).count() == 0


def test_nonnegative_risk_learns_without_negatives():
    from llm.toxicity import fit

    rng = np.random.default_rng(0)
    text = lambda toxic: np.unique(np.r_[rng.integers(100, 4000, 60), rng.integers(0, 20, 3) if toxic else []].astype(np.int32))
    model = fit([text(True) for _ in range(200)], [text(rng.random() < 0.1) for _ in range(1500)], 0.1, 12)
    score = lambda toxic: model(x := text(toxic), np.array([0, len(x)]))[0]
    assert np.mean([score(True) > 0.5 for _ in range(200)]) > 0.95 > 0.05 > np.mean([score(False) > 0.5 for _ in range(200)])


def test_rare_abuse_is_learnt():
    """Wording of 8 in 2,000 positives, under 1%, that no other text has."""
    from llm.toxicity import fit

    rng = np.random.default_rng(5)
    text = lambda *more: np.unique(np.r_[rng.integers(100, 4000, 40), list(more)].astype(np.int32))
    positive = [text(1, 2, 3) for _ in range(1992)] + [text(50, 51, 52) for _ in range(8)]
    model = fit(positive, [text() for _ in range(4000)], 0.1, bits=12)
    assert (model.weights[[1, 2, 3, 50, 51, 52]] > 0).all()


def test_toxic_features_are_counted_over_all_documents(spark, documents):
    import pyarrow as pa

    from llm.features import indicators
    from llm.toxicity import frequencies

    x, _ = indicators(pa.array([r["text"] for r in documents.select("text").collect()]))
    want = np.bincount(x, minlength=1 << 20)
    wanted = np.flatnonzero(want >= 2)[::3]
    got, n = frequencies(documents, wanted)
    assert n == documents.count() and (got[wanted] == want[wanted]).all() and got.sum() == want[wanted].sum()


def test_quality_fit_holds_narrow_values():
    """Beside the rows' numbers a fit holds four bytes for each feature, and a row widened when it is visited."""
    import tracemalloc

    from llm.quality import fit

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 14, 1500)).astype(np.int32) for _ in range(1000)]
    y = np.where(np.arange(1000) % 2, 1, -1)
    tracemalloc.start()
    fit(rows, y, 0.5, bits=14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 4 * sum(map(len, rows))
