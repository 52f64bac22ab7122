"""The mixture against a literal pivotal rounding, on repeated rows and clashing names."""

from __future__ import annotations

import math
import random
import struct
import time
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import mixture

from .test_operators import mixture_targets


def spark_hash(*values) -> int:
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, bool) else "<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def int_hash(seed: int, v: int) -> int:
    """One more column, a plain int literal."""
    got = xxhash.xxh64_intdigest(struct.pack("<i", v), seed & ((1 << 64) - 1))
    return got - (1 << 64) if got >> 63 else got


def meet(a, b, level, seed):
    """One is settled, the other goes on: (who goes on, who is settled)."""
    if a["p"] in (0.0, 1.0):
        return b, a
    a_up, a_down, b_up, b_down = (1 - a["p"]) * a["w"], a["p"] * a["w"], (1 - b["p"]) * b["w"], b["p"] * b["w"]
    up, down = min(a_up, b_down), min(a_down, b_up)
    u = int_hash(int_hash(spark_hash(a["h"], b["h"]), level), seed) % (1 << 40) / float(1 << 40)
    near = lambda p: 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p
    if u * (up + down) < down:
        if a_up <= b_down:
            return b | {"p": near(b["p"] - up / b["w"])}, a | {"p": 1.0}
        return a | {"p": near(a["p"] + up / a["w"])}, b | {"p": 0.0}
    if a_down <= b_up:
        return b | {"p": near(b["p"] + down / b["w"])}, a | {"p": 0.0}
    return a | {"p": near(a["p"] - down / a["w"])}, b | {"p": 1.0}


def literal_copies(rows, seed=7, block=mixture.BLOCK):
    """Copies by (doc_id, source, text, number) of rows (doc_id, text, source)."""
    seen, each = Counter(), []
    for doc_id, text, source in rows:
        key = doc_id, source, text
        size = len((text or "").split())
        text_hash = spark_hash(text)
        each.append({"key": (*key, seen[key]), "source": source, "size": size, "ids": (doc_id, text_hash, seen[key]), "w": float(size)})
        seen[key] += 1
    sizes, count = defaultdict(int), Counter(x["source"] for x in each)
    for x in each:
        sizes[x["source"]] += x["size"]
    targets, copies = mixture_targets(dict(sizes)), {}
    for source in sizes:
        due = min(targets[source] / sizes[source], 2.0) if sizes[source] else 0.0
        base, p = math.floor(due), due - math.floor(due)
        mine = [x for x in each if x["source"] == source]
        copies |= {x["key"]: base for x in mine}
        open_ = [x | {"p": p, "h": int_hash(spark_hash(*x["ids"]), seed)} for x in mine if p > 1e-12 and x["size"]]
        blocks = defaultdict(list)
        for x in open_:
            blocks[int_hash(spark_hash(*x["ids"]), seed + 1) % math.ceil(count[source] / block)].append(x)
        n, level, settled = math.ceil(max(count.values()) / block), 0, []
        while True:
            left = defaultdict(list)
            for k, items in blocks.items():
                held = None
                for x in sorted(items, key=lambda x: (x["h"], *x["ids"])):
                    if held is None:
                        held = x
                    else:
                        held, done = meet(held, x, level, seed)
                        settled.append(done)
                if held["p"] in (0.0, 1.0):
                    settled.append(held)
                else:
                    left[k // block].append(held)
            if n <= 1:
                for x in (x for items in left.values() for x in items):
                    settled.append(x | {"p": float(int_hash(int_hash(spark_hash(x["h"]), seed), -1) % (1 << 40) / float(1 << 40) < x["p"])})
                break
            blocks, n, level = left, math.ceil(n / block), level + 1
        miss = sum(x["size"] * x["p"] for x in settled) - sum(x["p"] * x["size"] for x in open_)
        ready, turns = [], Counter()
        for x in sorted(settled, key=lambda x: (int_hash(spark_hash(*x["ids"]), seed + 2), *x["ids"])):
            if x["p"] == (1.0 if miss > 0 else 0.0) and x["size"] <= abs(miss):
                power = int(math.log2(x["size"]))
                turns[power] += 1
                ready += [x] if turns[power] <= 2 else []
        flipped, room = set(), abs(miss)
        for x in sorted(ready, key=lambda x: (x["size"], *x["ids"]), reverse=True):
            if x["size"] <= room:
                room -= x["size"]
                flipped.add(x["key"])
        for x in settled:
            copies[x["key"]] = base + int(x["p"] if x["key"] not in flipped else 1 - x["p"])
    return copies


def some_rows(n, repeats, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices("abcdefg", k=rng.choice((0, 1, 5, rng.randint(1, 90))))), rng.choice("aaaab")) for k in range(n)]
    rows += [(n + k, None, "c") for k in range(3)]
    return rows + [rows[rng.randint(0, 9)] for _ in range(repeats)]


@pytest.mark.parametrize(("n", "repeats"), [(5, 0), (60, 30), (700, 500)])
def test_mixture_against_a_literal_rounding(spark, n, repeats, monkeypatch):
    rows = some_rows(n, repeats, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {(d, spark_hash(t)): t for d, t, _ in rows}
    want = sorted((key[0], key[1], key[2] or "", c) for key, c in literal_copies(rows).items())
    for at_once in (4096, 3):
        monkeypatch.setattr(mixture, "AT_ONCE", at_once)
        got = sorted((r["doc_id"], r["source"], texts[r["doc_id"], r["text_hash"]] or "", r["copies"]) for r in mixture.mixture_copies(docs).collect())
        assert got == want


def test_columns_of_any_name_come_through(spark):
    rows = [(k, "one two three " * (k % 5 + 1), "ab"[k % 2]) for k in range(40)] * 2
    names = ["_copy", "_copies", "_text_hash", "_d", "_s", "_h", "_doc_id", "_row", "_rows", "_part", "_number", "times", "number", "copies", "size", "target", "src", "block", "p"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    got = mixture.mixed(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert found and all(r[n] == f"{n} {r['doc_id']}" for r in found for n in names)
    assert len(found) == sum(r["copies"] for r in mixture.mixture_copies(docs).collect())
    assert mixture.mixed(docs.limit(0)).count() == 0


def test_equal_rows_take_about_as_long_as_different_ones(spark):
    def took(equal: bool) -> float:
        ids = F.lit(1).cast("long") if equal else F.col("id")
        docs = spark.range(30_000).select(ids.alias("doc_id"), F.lit("five words of some text").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
        began = time.time()
        assert mixture.mixture_copies(docs).count() == 30_000
        return time.time() - began

    took(False)
    times = {equal: sorted(took(equal) for _ in range(3))[1] for equal in (False, True)}
    assert times[True] < 2 * times[False] + 2
