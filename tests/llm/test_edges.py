"""Awkward rows of the ten operators and brute-force versions of what has no SQL."""

from __future__ import annotations

import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import ann, chat, common, decontaminate, html_text, mixture, near_dups, piece_counts, quality, queries, token_store, warc
from flowlens.sources.tables import scratch_run

from .test_operators import SF_DIR, awkward_texts, documents, extracted, mixture_targets

DOCS_01 = "/root/testdata/sf0.01"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_ids_of_all_documents_are_the_tokenizers(spark):
    docs = queries.table(spark, DOCS_01, "documents").orderBy("doc_id").collect()
    encoder, start = tokenizer(), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_token_output(spark, DOCS_01).collect()}
    for r in docs:
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ids_of_odd_words_are_the_tokenizers():
    rng = random.Random(7)
    signs = [*"aBzé.,'-(<|>\x00\x7f", "İ", "ı", "Σ", "ß", "ŉ", "Ⱥ", "̇", "́", " ", "\t", " ", "\n", "1", "字", "<|endoftext|>", "'s", "Å"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(20_000)] + ["Zİ,", "x<|endoftext|>."]
    encoder = token_store.WordEncoder(queries.tokenizer_path())
    assert encoder.by_words and encoder.encode(texts) == encoder.whole(texts)


def test_tokenizers_of_other_rules_get_whole_texts(tmp_path):
    rules = json.loads(tokenizer().to_str())
    rules["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(rules))
    encoder = token_store.WordEncoder(str(tmp_path / "t.json"))
    assert not encoder.by_words and encoder.encode(["Ab cd"]) == encoder.whole(["Ab cd"])


def test_store_of_repeated_and_missing_ids(spark):
    rows = [(None, "no id"), (2, "two"), (1, "one b"), (1, "one a"), (1, "one a"), (None, "no id either"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash")).withColumn("text_hash", F.lit(0))
    path, encoder = common.scratch_path(spark, "tokens"), tokenizer()
    token_store.write_store(docs, path, queries.tokenizer_path(), 2)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2, 3]
    sizes = sorted(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r["n_tokens"] for r in got) == sizes
    all_ids = [token_store.token_at(spark, path, k) for k in range(sum(sizes))]
    for r in got:
        mine = np.array(all_ids[r["start"] : r["start"] + r["n_tokens"]], "<u4")
        assert zlib.crc32(mine.tobytes()) == r["ids_crc32"]
    for outside in (-1, sum(sizes)):
        with pytest.raises(IndexError):
            token_store.token_at(spark, path, outside)
    assert token_store.token_output(docs.limit(0), queries.tokenizer_path()).count() == 0


def neighbours(spark, rows, kind="double", **more):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("gid", F.lit("clash")).withColumn("d", F.lit(0))
    got: dict = {}
    for r in ann.nearest(table, "vec_id % 100 = 0", **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_neighbours_at_equal_distance_go_by_id(spark):
    rows = [(0, [0.0, 0.0, 1.0])] + [(k, [float(np.cos(k)), float(np.sin(k)), 1.0]) for k in range(30, 0, -1)]
    rows = [(k, v) if k == 0 else (k, [[1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [-1.0, 0.0, 1.0], [0.0, -1.0, 1.0]][k % 4]) for k, v in rows]
    assert [v for v, _ in neighbours(spark, rows)[0]] == list(range(1, 11))


def test_neighbours_of_several_lengths_in_double_precision(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0 + 3e-12, 0.0]), (3, [1e200, 0.0]), (100, [1.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0]), (200, [5.0])]
    got = neighbours(spark, rows)
    assert [v for v, _ in got[0]] == [1, 2, 3] and got[0][0][1] == pytest.approx(1e-12, rel=1e-3)
    assert [v for v, _ in got[100]] == [101] and 200 not in got


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(0, [0.9, 0.1]), (1, [0.8, 0.2]), (1, [0.8, 0.2]), (2, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(table, "vec_id = 0").collect())
    want = [(1, 1, 0.141421), (1, 1, 0.282843), (2, 2, 1.272792), (2, 2, 1.414214)]
    assert got == want


def test_recall_with_a_small_share_reranked(spark):
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found: dict = {}
    for r in queries.op2_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in found:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        hits += len(found[q] & set([int(i) for i in ids[np.lexsort((ids, far))] if i != q][:10]))
    assert max(ann.RERANK_LEAST, ann.RERANK * len(ids)) <= 0.1 * len(ids) and hits / (10 * len(found)) >= 0.9


def test_windows_of_mixed_scripts(spark):
    rng = random.Random(2)
    signs = ["Α", "Σ", "Β", "σ", "ς", "'", ".", " ", "a", "Z", "İ", "1"]
    texts = ["x ΑΣ'Β y"] + ["".join(rng.choices(signs, k=rng.randint(3, 12))) for _ in range(150)]
    items = [("i0", "ΑΣ'Β")] + [(f"i{k}", rng.choice(texts)[: rng.randint(2, 8)]) for k in range(1, 40)]
    from .test_operators import brute_contamination

    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["item_ids"]), r["contaminated"]) for r in decontaminate.mark_contaminated(docs, bench).collect()}
    assert got == {r[0]: (r[1], r[2], r[3], r[5]) for r in brute_contamination(list(enumerate(texts)), items)}
    assert got[0][1:] == (2, 1, True)


def test_proximity_finds_moved_words(spark):
    words = [f"w{k}" for k in range(10)]
    loose = [*words[:3], "new", *words[3:]]
    far = [*words[:3], *["gap"] * 30, *words[3:]]
    docs = documents(spark, [" ".join(x) for x in (words, loose, far, ["else"] * 20)])
    items = spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    got = {r["doc_id"] for r in decontaminate.proximity_matches(docs, items, slop=2).collect()}
    assert {0, 1} <= got and 3 not in got
    assert [r["doc_id"] for r in decontaminate.mark_contaminated(docs, items).where("contaminated").collect()] == [0]
    assert decontaminate.proximity_matches(docs.limit(0), items).count() == 0


def test_piece_counts_of_no_rows_and_clashing_columns(spark):
    docs = documents(spark, ["one two", None]).withColumn("n_words", F.lit("clash"))
    assert sorted(r["n_words"] for r in piece_counts.piece_counts(docs, queries.tokenizer_path()).collect()) == [0, 2]
    assert piece_counts.piece_counts(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    same, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, same, "x"), (5, other, "y"), (7, same + " more", "z"), (9, other, "w"), (11, "alone in this", "v"), (None, same, "n"), (None, same, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_dups.near_duplicates(docs, 2).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]
    kept = [tuple(r)[:3] for r in near_dups.deduplicated(docs, 2).collect()]
    again = [tuple(r)[:3] for r in near_dups.deduplicated(docs.repartition(5), 2).collect()]
    assert sorted(kept, key=str) == sorted(again, key=str) and sum(r[0] == 5 for r in kept) == 1 and sum(r[0] is None for r in kept) == 2


def test_near_duplicates_under_one_shared_passage(spark):
    """Many texts of one passage and a few words of their own: the prefix join must not miss pairs of unlike sizes."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join(passage[: rng.randint(4, 30)] + [f"u{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))]) for _ in range(120)]
    from .test_operators import brute_classes

    got = near_dups.near_duplicates(documents(spark, texts), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_classes(list(enumerate(texts)), 2)


def test_mixture_of_repeated_rows(spark):
    rng = random.Random(4)
    base = [(i % 90, " ".join(["w"] * rng.randint(1, 60)), "en", "abc"[i % 3], i % 2) for i in range(300)]
    docs = spark.createDataFrame(base * 4, "doc_id long, text string, lang string, source string, n_chars int")
    got = mixture.mixture_copies(docs).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    for s, want in mixture_targets(sizes).items():
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want) <= 4 * max(r["size"] for r in mine)
    rows = sorted(map(tuple, mixture.mixed(docs).collect()))
    assert rows == sorted(map(tuple, mixture.mixed(docs.repartition(9)).collect())) and len(rows) == sum(r["copies"] for r in got)


def test_revisits_at_equal_times_and_of_a_hot_url(spark):
    rows = [(1, "http://a.org/", 5, 200, {"etag": "1"}), (2, "http://a.org/", 5, 200, {"etag": "2"}), (3, "http://a.org/", 5, 304, {"etag": "2"}), (4, "http://a.org/", 6, 304, {"etag": "2"}), (4, "http://a.org/", 6, 304, {"etag": "2"})]
    rows += [(1000 + k, "http://hot.org/", k, 200 if k % 10 == 0 else 304, {"etag": str(k // 10)}) for k in range(2000)]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    got = [(r["record_id"], r["outcome"], r["response_id"]) for r in warc.resolve_revisits(records).collect()]
    assert sorted(x for x in got if x[0] < 1000) == [(3, "no earlier response", None), (4, "resolved", 2), (4, "resolved", 2)]
    assert sorted(x for x in got if x[0] >= 1000) == [(1000 + k, "resolved", 1000 + k // 10 * 10) for k in range(2000) if k % 10]


def test_revisits_do_not_depend_on_the_slices(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["http://a.org/", "http://b.org/x", None]), rng.choice([rng.randint(0, 300), None]) if k % 9 == 0 else rng.randint(0, 300), rng.choice([200, 304, 304, 404]), {"etag": str(rng.randint(0, 2))}) for k in range(900)]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    kept = [(k, url, ts) for k, url, ts, status, _ in rows if status == 200 and url is not None and ts is not None]
    want = {k: max(((t, i) for i, u, t in kept if u == url and t < ts), default=(None, None))[1] if url is not None and ts is not None else None for k, url, ts, status, _ in rows if status == 304}
    for slices in (1, 5, 200, None):
        assert {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(records, slices).collect()} == want


def test_scores_against_literal_word_vectors(spark):
    texts = ["One two one", "two TWO, three!", None, "", "four"]
    got = quality.word_vectors(documents(spark, texts))
    terms, (places, signs) = quality.Terms(), quality.index_vectors()
    sums, counts = np.zeros((quality.TERMS, quality.DIMENSIONS)), np.zeros(quality.TERMS)

    def add(of, around):
        for k in range(quality.NONZERO):
            sums[of, places[around, k]] += signs[around, k]

    for text in texts:
        letters, shapes = (x.tolist() for x in terms(text))
        for i in range(len(letters)):
            for kind in (letters, shapes):
                counts[kind[i]] += 1
                add(kind[i], shapes[i])
                for j in (i - 1, i + 1):
                    if 0 <= j < len(letters):
                        add(kind[i], kind[j])
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got[:, :-1], want, atol=1e-6)
    share = counts[: quality.LETTER_TERMS] / counts[: quality.LETTER_TERMS].sum()
    seen = np.flatnonzero(share)
    assert np.allclose(got[seen, -1], 1e-3 / (1e-3 + share[seen]), rtol=1e-5)


def test_one_table_of_words_is_held():
    a = common.remembered("a", 1000)
    a.update({b"x": 1, b"y": 2})
    a.learned([b"x", b"y"])
    assert common.remembered("a") is a and a.used > 200
    a.limit = 100
    a.make_room()
    assert not a and common.remembered("b") is not a and common.remembered("a") is not a


def test_a_long_conversation(spark):
    turns = spark.range(3000).selectExpr("id div 1500 as conv_id", "id % 1500 as turn", "if(id % 2 = 0, 'user', 'bot') as role", "concat('t', id % 1500) as text").where("conv_id = 0 or turn < 1400")
    got = chat.formatted_chats(turns).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(0, 1500)] and got[0]["rendered"].count("<|turn|>") == 1500


def test_deep_and_unclosed_pages(spark):
    deep = "<html><body>" + "".join(f"<div class='a{chr(97 + i % 26)}{'bcdefghij'[i // 26 % 9]}'>" for i in range(6000)) + "<p>deep {}</p>"
    ragged = "<b>" * 20_000 + "<p>x" * 20_000 + "<form>" * 5_000 + "text {}" + "<a " * 50_000
    got = extracted(spark, [("http://d.org/", deep.format(0)), ("http://d.org/", deep.format(1)), ("http://e.org/", ragged.format(0)), ("http://e.org/", ragged.format(1))])
    assert got[:2] == ["deep 0", "deep 1"] and all(t.startswith("x\n\nx") for t in got[2:])
    assert extracted(spark, [("http://v.org/", "<p>" + "word " * 400_000 + "</p>")])[0].count("word") == 400_000


def test_slots_against_walks_up_the_tree(spark):
    rng, up, once = random.Random(1), {("h", 0): None}, {("h", 0)}
    chain = 0
    for k in range(1, 400):
        chain = k - 1 if rng.random() < 0.97 else rng.randint(0, k - 1)
        up["h", k] = chain
        if rng.random() < 0.01:
            once.add(("h", k))
    rows = []
    for host, k in up:
        around, at = [], k
        while at is not None and len(around) < html_text.LINE:
            around.append(at)
            at = up[host, at]
        rows.append((host, k, at or 0, around))
    elements = spark.createDataFrame(rows, "host string, id long, beyond long, around array<long>")
    got = {(r["host"], r["id"]): r["slot"] for r in html_text._slots_of(elements, spark.createDataFrame(list(once), "host string, slot long")).collect()}

    def walk(host, k):
        while (host, k) not in once:
            k = up[host, k]
        return k

    assert got == {x: walk(*x) for x in up}


def test_last_stages_of_the_pipeline_and_whole_runs(spark, tmp_path):
    docs = queries.table(spark, SF_DIR, "documents")
    mixed = corpus_pipeline.mixture_stage(spark, docs, SF_DIR)
    taken = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed.columns == docs.columns
    assert taken == {r["doc_id"]: r["copies"] for r in mixture.mixture_copies(docs).collect() if r["copies"]}
    encoder, start = tokenizer(), 0
    stored = corpus_pipeline.token_stage(spark, mixed, SF_DIR).orderBy("start").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(stored) == sum(taken.values())
    for r in stored:
        ids = np.array([*encoder.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("texts", [[], [None, "", "one", "one", "word " * 5000, None]])
def test_pipeline_of_few_and_awkward_rows(spark, tmp_path, texts):
    docs = documents(spark, texts).withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1.0))
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([("i", None), ("j", "")], "item_id string, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert sorted(out.columns) == sorted(docs.columns)
    assert corpus_pipeline.run(spark, sf_dir).count() <= 2 * len(texts)


def test_a_run_leaves_its_results_only(spark):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    folders = lambda: {p.name for p in top.iterdir()} if top.exists() else set()
    before = folders()
    docs = spark.createDataFrame([(k, f"one two three four five {k % 3}") for k in range(9)], "doc_id long, text string")
    with scratch_run(spark):
        kept = sorted(r["doc_id"] for r in near_dups.deduplicated(docs, width=5, threshold=80).collect())
    assert kept == sorted(r["doc_id"] for r in near_dups.deduplicated(docs, width=5, threshold=80).collect())
    assert folders() > before  # without a run its tables stay
    before = folders()
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    names = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES]
    own = {n.rsplit("-", 1)[0] for n in folders() - before}
    assert set(names) <= own and not any(n.startswith("run") for n in own)
