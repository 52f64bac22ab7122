"""Fill-in-the-middle, whitening and substring dedup against brute-force versions, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import fill_middle, queries, repeats, whitening
from tests.oracle import assert_same, connection

from .test_operators import SF_DIR, awkward_texts, documents

FIM_COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_sql(spark):
    assert_same(queries.op11_fill_in_middle(spark, SF_DIR).select(FIM_COLUMNS), connection(SF_DIR), fill_middle.ORACLE)


def literal_fim(doc_id, text, seed=7, share=100, spm_share=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= share:
        return len(lines), "plain", None, None, None, text
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    return (len(lines), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_share else (len(lines), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_of_awkward_texts(spark):
    rng = random.Random(3)
    texts = [*awkward_texts(), "\n", "\n\n\nx", "a\r\nb\rc d\n", "𝄞é\n𝄞\n", "with <M> in it\nand more", "ends with <\n<S", "S>\nP>\n", "<P\n>\n<", "x\n" * 5000 + "y" * 70_000 + "\n" + "z\n" * 300]
    texts += ["".join(rng.choices(["a", "字", "\n", " ", "<", "S>", "P", ">"], k=rng.randint(1, 300))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id\nat all\n"), (3, "repeated\nid"), (3, "repeated\nid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("output", F.lit(1))
    for share, spm in ((100, 50), (60, 0)):
        found = fill_middle.fill_in_middle(docs, share=share, spm_share=spm).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        got = sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["again"])) for r in found)
        assert got == sorted(repr((d, *literal_fim(d, t, 7, share, spm), t or "")) for d, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rank_index_gives_each_boundary():
    rng = np.random.default_rng(5)
    for most in (1, 2, 90, 5000):
        for n in (0, 1, 2, 63, 64, 65, 1000):
            b = np.concatenate([[0], np.cumsum(rng.integers(1, most + 1, n))])
            index = fill_middle.RankIndex(b)
            assert [index.offset(k) for k in range(n + 1)] == b.tolist()
            assert index.residuals.dtype == np.int8 and len(index.firsts) <= n + 1
    assert len(fill_middle.RankIndex(np.arange(0, 100_000, 10)).firsts) == 1  # even lines take one segment


def literal_whitening(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = (x - s / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:32]
    return rows, n, deviation, y, e[order], u[:, order], e.sum()


def test_whitening(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SF_DIR, "embeddings").collect()]
    rows, n, deviation, y, e, u, trace = literal_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.op12_whitening(spark, SF_DIR).collect()}
    assert len(got) == len(rows) * 32
    white = np.array([[got[i, k + 1]["whitened"] for k in range(32)] for i, _ in rows])
    want = y @ u / np.sqrt(e)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-7
    one = [r for r in got.values() if r["component"] == 1]
    assert {(r["n"], r["deviation"]) for r in one} == {(n, d) for d in deviation}
    assert all(got[rows[0][0], k + 1]["explained"] == pytest.approx(e[k] / trace, rel=1e-9) for k in range(32))
    assert {r["identity_error"] for r in got.values()} == {one[0]["identity_error"]} and one[0]["identity_error"] < 1e-8


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, [-1.0, 0.5, 0.0]), (2, [-1.0, 0.5, 0.0]), (3, [0.3, -7.0, 0.0]), (None, [4.0, 4.0, 0.0]), (5, None), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (11, [1e30, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("whitened", F.lit("clash")).withColumn("v", F.lit(0))
    used, n, deviation, y, e, u, trace = literal_whitening(rows[:5])
    got = whitening.whiten(table).collect()
    assert sorted(map(repr, ((r["vec_id"], r["n"], int(r["deviation"])) for r in got))) == sorted(map(repr, ((i, n, d) for (i, _), d in zip(used, deviation, strict=True))))
    assert {len(r["whitened"]) for r in got} == {2}  # the third dimension doesn't vary
    assert got[0]["explained"] == pytest.approx([e[0] / trace, e[1] / trace])
    for few in (table.limit(0), table.where("vec_id = 1"), table.where("vec_id = 2")):
        assert whitening.whiten(few).select(F.explode("whitened")).count() == 0


def test_components_of_hard_spectra():
    rng = np.random.default_rng(2)
    for spectrum in ([5, 5, 5, 1, 1, 0], [1, 1, 1, 1], [1e6, 1, 1e-3, 1e-3], np.arange(1, 60), 1 + 1e-9 * np.arange(12), 2.0 ** -np.arange(30)):
        spectrum = np.array(spectrum, float)
        q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.top_components(a)
        want = np.sort(spectrum)[::-1][:32]
        want = want[want > len(spectrum) * 1e-13 * want[0]]
        assert np.abs(values - want).max() < 1e-12 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        for shift in (0.5, 1.5, 30.5):
            assert whitening.inertia(a, shift) == (spectrum < shift).sum()


def literal_repeats(rows, width=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in words:
        if d is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(d, least.get(key, d))
    for d, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if d is not None and least[tuple(w[k : k + width])] < d:
                gone |= set(range(k, k + width))
        yield d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_substring_dedup(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, queries.op13_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == sorted((d, n, r, sha(kept)) for d, n, r, kept in literal_repeats(rows))
    assert any(0 < r < n for _, n, r, _ in got)


def test_substring_dedup_of_awkward_texts(spark):
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [*awkward_texts(), "word " * 500, passage, "é \x0b\x0c\t x\r\n" + passage.replace(" ", "\n\t") + "\x1c tail", passage[:120] + " cut " + passage, "other " * 12 + "end", "other " * 12 + "end"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(10, 120))) for _ in range(60)]
    rows = [*enumerate(texts), (None, passage), (None, None), (12, "before " + passage), (12, "before " + passage), (12, "other text of this id"), (-5, texts[-1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("text_key", F.lit(3)).withColumn("hot", F.lit(1))
    want = sorted(map(repr, literal_repeats(rows)))
    assert sorted(map(repr, map(tuple, repeats.without_repeats(docs).collect()))) == want
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_results_do_not_depend_on_hot_minimisers(spark, monkeypatch):
    rng = random.Random(12)
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(k, f"{' '.join(rng.choices('abcdefgh', k=9))} {common} {' '.join(rng.choices('abc', k=20))}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(literal_repeats(rows))
    for hot in (1, 50, 10**9):
        monkeypatch.setattr(repeats, "HOT", hot)
        assert sorted(map(tuple, repeats.without_repeats(docs).collect())) == want
