import math

import pytest

from papyra.llm import katz

from . import brute


def check(out, want):
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert len(got) == len(want)
    for r, w in zip(got, sorted(want), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize(("chunk", "span", "common"), [(16 << 20, 16 << 20, 400), (2000, 8000, 20)])
def test_against_plain(docs, texts, monkeypatch, chunk, span, common):
    monkeypatch.setattr(katz, "CHUNK_TEXT", chunk)
    monkeypatch.setattr(katz, "RANGE_TEXT", span)
    monkeypatch.setattr(katz, "COMMON", common)
    check(katz.score(docs), brute.katz(texts)[0])


def test_tables(spark, sf, monkeypatch):
    from papyra.llm.queries import op10_katz

    monkeypatch.setattr(katz, "RANGE_TEXT", 100_000)
    read = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, p, words = brute.katz(read)
    check(op10_katz(spark, sf), want)
    seen = [h for h in (("\0start", "\0start"), ("\0start", "the"), ("of", "the"), ("unseen", "history"), ("unseen", "de"))]
    for history in seen:
        assert math.isclose(sum(p(*history, *w) for w in words) + p(*history, "a word that is not known"), 1, rel_tol=1e-9), history
    held = [w for w in want if w[1]]
    assert sum(w[6] for w in held) > sum(w[5] for w in held) * 1.5


def test_copies(spark):
    """Histories whose n-grams are all frequent still leave weight to what was not seen after them."""
    data = [(i, "x y z") for i in range(40)] + [(100 + i, "x y q") for i in range(8)] + [(200 + i, f"x{i} y z") for i in range(9)]
    check(katz.score(spark.createDataFrame(data, "doc_id long, text string")), brute.katz(data)[0])


def test_discounts():
    assert katz.discounts([0] * 6) == [(r - 0.5) / r for r in range(1, 6)]
    assert all(0 < d < 1 for d in katz.discounts([100, 40, 20, 12, 8, 5])) and all(0 < d < 1 for d in katz.discounts([1, 500, 0, 3, 0, 9]))
    for n in ([100, 40, 20, 12, 8, 5], [9000, 2100, 900, 500, 300, 210], [5, 5, 5, 5, 5, 5]):
        kept = brute.good_turing([r for r, x in enumerate(n, 1) for _ in range(x)])
        assert [r * d for r, d in enumerate(katz.discounts(n), 1)] == pytest.approx([kept(r) for r in range(1, 6)]) and kept(6) == 6


def test_empty_and_no_training(spark, nothing):
    assert katz.score(nothing).count() == 0
    held = [(i, "a b") for i in range(60) if brute.held_out(i)]
    out = katz.score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 == r.score for r in out) and out
