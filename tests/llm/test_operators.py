"""The ten operators against brute-force versions, round trips and their SQL, with the awkward rows that each must bear."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import ann, chat, decontaminate, html_text, mixture, near_dups, piece_counts, quality, queries, token_store, warc
from tests.oracle import assert_same, connection

SF_DIR = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts() -> list[str | None]:
    return [None, "", "   ", "One", "one two", "日本語 テキスト é", "word " * 30_000, "<|endoftext|> x", "same text here", "same text here"]


def documents(spark, texts, schema=DOC_SCHEMA):
    return spark.createDataFrame([(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)], schema)


def test_codes_give_any_token_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        ids = rng.choice([3, 255, 256, 40_000, 70_000], n).astype(np.uint32)
        reader = token_store.DacReader(token_store.dac_encode(ids))
        assert reader.all().tolist() == ids.tolist()
        assert [int(reader[i]) for i in range(n)] == ids.tolist()


def test_token_output(spark):
    from tokenizers import Tokenizer

    texts = awkward_texts()
    path = queries.tokenizer_path()
    got = {r["doc_id"]: r for r in token_store.token_output(documents(spark, texts), path, 2).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_nearest_neighbours(spark):
    table = queries.table(spark, SF_DIR, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found: dict[int, list] = {}
    for r in queries.op2_nearest_neighbours(spark, SF_DIR).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(i) for i in ids[np.lexsort((ids, far))] if i != q][:10]
        assert [r for r, _, _ in found[q]] == list(range(1, 11))
        assert all(s == pytest.approx(far[ids == v][0], rel=1e-12, abs=1e-12) for _, v, s in found[q])
        hits, total = hits + len(set(best) & {v for _, v, _ in found[q]}), total + 10
    assert hits / total >= 0.9


def test_nearest_neighbours_of_few_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 100 = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.0), (2, pytest.approx(math.sqrt(2)))]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_contamination(docs, items):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item_id)
    lengths = {len(k) for k in windows}
    for doc_id, text in docs:
        w, hit, held = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    held |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(held), digest, bool(hit)


def test_decontamination(spark):
    docs, items = queries.table(spark, SF_DIR, "documents"), queries.table(spark, SF_DIR, "benchmark")
    want = sorted(brute_contamination(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()))
    got = queries.op3_decontamination(spark, SF_DIR).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[5] for r in want)


def test_decontamination_of_awkward_rows(spark):
    docs = documents(spark, awkward_texts()).withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1))
    items = spark.createDataFrame([("i1", "One"), ("i2", None), ("i3", ""), ("i4", "same TEXT, here"), ("i4", "same TEXT, here")], "item_id string, text string")
    got = sorted((r["doc_id"], r["contaminated"], r["n_hit"]) for r in decontaminate.mark_contaminated(docs, items).collect())
    assert [x[0] for x in got if x[1]] == [3, 4, 8, 9]
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 6
    assert decontaminate.mark_contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()


def test_decontamination_by_items_without_id_and_with_sigma(spark):
    docs = documents(spark, ["one two three", "said \u039f\u0394\u039f\u03a3.\u0391 in full", "else"])
    items = spark.createDataFrame([(None, "one two three"), ("s", "\u039f\u0394\u039f\u03a3.\u0391")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontaminate.mark_contaminated(docs, items).collect()}
    assert got == {0: (3, [], True), 1: (2, ["s"], True), 2: (0, [], False)}
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [2]


def greedy(word: bytes, pieces: set[bytes]) -> int:
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_piece_counts():
    rng = random.Random(3)
    pieces = {"".join(rng.choices("abc", k=rng.randint(1, 5))).encode() for _ in range(25)} - {b"c"}
    words = ["".join(rng.choices("abc", k=rng.randint(1, 14))).encode() for _ in range(800)]
    assert piece_counts.PieceCounter(pieces, pieces).counts(words).tolist() == [greedy(w, pieces) for w in words]


def test_piece_counts_of_documents(spark):
    path = queries.tokenizer_path()
    pieces, texts = piece_counts.word_end_vocabulary(path), awkward_texts()
    got = sorted(map(tuple, piece_counts.piece_counts(documents(spark, texts), path).collect()))
    split = [(t or "").encode().lower().split() for t in texts]
    assert got == [(i, len(w), sum(greedy(x, pieces) for x in w)) for i, w in enumerate(split)]


def test_piece_counts_with_word_ends_from_the_file(spark):
    import json
    from pathlib import Path

    path = queries.tokenizer_path()
    vocab = json.loads(Path(path).read_text())["model"]["vocab"]

    def pieces_of(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(len(word), at, -1) if (word[at:e] + "</w>" * (e == len(word))) in vocab)
            n += 1
        return n

    rng, plain = random.Random(7), [p.removesuffix("</w>") for p in vocab if re.fullmatch("[a-z]+(</w>)?", p)]
    unended = sorted(p for p in vocab if re.fullmatch("[a-z]+", p) and p + "</w>" not in vocab)
    words = unended + ["".join(rng.choices(plain, k=rng.randint(1, 3))) for _ in range(3000)]
    got = {r["doc_id"]: r["n_pieces"] for r in piece_counts.piece_counts(documents(spark, words), path).collect()}
    assert [got[i] for i in range(len(words))] == [pieces_of(w) for w in words]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_classes(docs, width):
    sets = {i: shingles(t, width) for i, t in docs}
    found, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(found):
        for b in found[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in found)


def test_near_duplicates(spark):
    docs = queries.table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    got = queries.op5_near_duplicates(spark, SF_DIR).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_classes(docs, 2)


def test_near_duplicates_in_chains_and_crowds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
    texts = awkward_texts()
    for k in range(40):  # each step changes one more word: far ends are joined only through the chain
        texts.append(" ".join([*(f"x{j}" for j in range(k)), *base[k:]]))
    texts += [" ".join(f"y{rng.randint(0, 9999)}" for _ in range(25)) for _ in range(20)] + ["common line of words that all share"] * 15
    docs = documents(spark, texts).withColumn("node", F.lit(1)).withColumn("key", F.lit("clash"))
    for width in (2, 5):
        got = near_dups.near_duplicates(docs, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got)) == brute_classes(list(enumerate(texts)), width)
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute_classes(list(enumerate(texts)), 5) if r[3]]
    assert near_dups.near_duplicates(docs.limit(0), 2).count() == 0


def mixture_targets(sizes: dict, share=1.5, most=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


def test_mixture(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    got = mixture.mixture_copies(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.mixture_copies(docs.repartition(7)).collect()), key=str)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in docs.select("doc_id").collect())
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["copies"] <= 2
    want = mixture_targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == size for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want[s]) <= max(r["size"] for r in mine)


def test_mixture_of_awkward_rows(spark):
    docs = documents(spark, awkward_texts()).withColumn("p", F.lit(1)).withColumn("copies", F.lit(9))
    assert mixture.mixture_copies(docs).count() == 10
    assert mixture.mixed(docs).columns == docs.columns
    assert mixture.mixture_copies(docs.limit(0)).count() == 0
    assert mixture.mixture_copies(docs.union(docs)).count() == 20


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF_DIR), connection(SF_DIR), queries.ORACLE_SQL[name])


def test_revisits_of_awkward_rows(spark):
    rows = [(1, "http://a.org/x", 5, 200, {"etag": "1", "date": "old"}), (2, "https://www.A.org:443/x/", 9, 304, {"etag": "W/1", "date": "new"}), (3, None, 9, 304, None), (4, "http://a.org/x", None, 304, None), (5, "http://a.org/x", 5, 304, None), (6, "http://b.org/", 7, 404, None)]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>").withColumn("slice", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    assert sorted(got) == [2, 3, 4, 5]
    assert (got[2]["outcome"], got[2]["response_id"], got[2]["headers"]) == ("resolved", 1, {"etag": "W/1", "date": "new"})
    assert {got[k]["outcome"] for k in (3, 4, 5)} == {"no earlier response"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    seen = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.where("quality is not null").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in seen if q == 1], [s for s, q in seen if q == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= 0.9


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, awkward_texts()).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality.scores(docs, labels).collect()) == list(range(10))
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.scores(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.scores(docs, labels.limit(0)).count() == 10


def test_chats_of_awkward_rows(spark):
    rows = [(1, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, None, None), (3, 1, "user", "a"), (3, 2, None, None), (4, 1, None, "<|end|>"), (None, 1, "user", "z"), (4, 1, None, "<|end|>")]
    # Rows without a conv_id: each its own conversation, unless equal to or the beginning of another one.
    rows += [(None, 1, "user", "z"), (None, 7, "user", "z"), (None, 2, "bot", "y"), (None, None, "user", "a"), (None, 3, None, "<|end|>"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("clash"))
    found = chat.formatted_chats(turns).collect()
    got = {r["conv_id"]: r for r in found if r["conv_id"] is not None}
    assert set(got) == {2, 4}
    lone = {r["rendered"]: (r["n_turns"], r["n_equal"]) for r in found if r["conv_id"] is None}
    assert lone == {"<|turn|>user\nz<|end|>": (1, 2), "<|turn|>bot\ny<|end|>": (1, 1), "<|turn|>unknown\n<|end|>": (1, 1)}
    assert (got[4]["n_turns"], got[4]["n_equal"]) == (1, 2)
    assert (got[2]["n_turns"], got[2]["n_equal"]) == (2, 2)
    assert got[4]["rendered"] == "<|turn|>unknown\n<<|end|><|end|>"
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    assert_same(chat.formatted_chats(turns), con, chat.ORACLE)
    assert chat.formatted_chats(turns.limit(0)).count() == 0


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head {0}</h1><p>Text &amp; more\n {0}</p><div class='ad'>Buy</div></article><div class='comments'><p>Nice</p></div><footer>End</footer><script>x</script></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(5)] + [(5, None, None), (6, "http://h.org/e", ""), (7, "x", "bare words"), (7, "x", "bare words")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("slots", F.lit(1))).collect()}
    assert got == {i: f"Head {i}\n\nText & more {i}" for i in range(5)} | {5: "", 6: "", 7: "bare words"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_html_of_a_host_with_odd_pages(spark):
    page = "<html><body><div class='rail'>Rail {0}</div><article><p>Text {0}</p></article></body></html>"
    odd = [None, "", "<p>stub</p>", "<html><body><div class='rail'>Rail</div><article><p>One</p></article><article><p>Two</p></article></body></html>"]
    got = extracted(spark, [("http://h.org/", page.format(i)) for i in range(4)] + [("http://h.org/", x) for x in odd])
    assert got == [f"Text {i}" for i in range(4)] + ["", "", "stub", "One\n\nTwo"]


def test_html_text_that_repeats_on_a_host(spark):
    page = "<html><body><article><h1>Head {0}</h1><p>Some text of page {0}, said once</p><p class='hint'>Tell others</p><p>More at {1}</p></article></body></html>"
    plain = "<html><body><div class='x'><p>Lead {0} of this page</p></div><div class='y'><p>Body {0} of this page</p></div><div class='z'><p>Our motto</p></div></body></html>"
    pages = [("http://a.org/", page.format(i, "one" if i < 6 else "two")) for i in range(12)] + [("http://b.org/", plain.format(i)) for i in range(3)]
    copies = [("http://c.org/", f"<html><body><nav>{i}</nav><article><p>Same copy of a text</p><p>Other {i}</p></article></body></html>") for i in range(3)]
    got = extracted(spark, pages + copies)
    assert got[:12] == [f"Head {i}\n\nSome text of page {i}, said once\n\nMore at {'one' if i < 6 else 'two'}" for i in range(12)]
    assert got[12:15] == [f"Lead {i} of this page\n\nBody {i} of this page" for i in range(3)]
    assert got[15:] == [f"Same copy of a text\n\nOther {i}" for i in range(3)]


def test_html_of_names_that_only_look_like_boilerplate(spark):
    bodies = ["<div class='content has-sidebar'><article><p>A</p></article></div>", "<div id='page' class='no-sidebar'><p>B</p></div>", "<section class='post with-comments'><p>C</p></section>"]
    bodies += ["<div class='search-result'><p>D</p></div>", "<div class='widget'><article><p>E</p></article></div>", "<form><aside><article><p>teaser</p></article></aside><article><p>F</p></article></form>"]
    bodies += ["<article><p>G <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><svg><path d='M0'/><path d='M1'/><text>chart</text></svg><object><p>in its place</p></object></article>"]
    bodies += ["<article><p>H</p><div class='comments'><p>reply</p></div></article>", "<form class='search'><p>I</p></form>", "<article><p>J <span class='share'>Share</span> <b class='shared'>K</b></p></article>"]
    got = extracted(spark, [(f"http://h{i}.org/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)])
    assert [" ".join(t.split()) for t in got] == ["A", "B", "C", "D", "E", "F", "G x=1 chart in its place", "H", "I", "J K"]
    page = "<html><body><article><p>Text {0}</p>{1}</article></body></html>"
    notes = ["<div class='notice'><p>Own {0}</p></div>"] + ["<div class='comment'><p>Said {0}</p></div>"] * 3
    assert extracted(spark, [("http://h.org/", page.format(i, n.format(i))) for i, n in enumerate(notes)]) == ["Text 0\n\nOwn 0", "Text 1", "Text 2", "Text 3"]


def test_pipeline(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, SF_DIR).cache()
        before, left = kept.select("doc_id", "text").collect(), {r["doc_id"] for r in after.collect()}
        assert after.columns == docs.columns
        if name == "MinHash near-dedup":
            assert left == {r[0] for r in brute_classes(before, 5) if r[3]}
        elif name == "benchmark decontamination":
            items = queries.table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()
            assert left == {r[0] for r in brute_contamination(before, items) if not r[5]}
        kept = after
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in kept.collect()}
