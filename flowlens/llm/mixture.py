"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document gets its source's target over its source's size as copies: the whole part for certain, the rest
as a probability p.  Two documents with fractions meet: words move from one to the other (either way, with
chances that leave both expectations as they were) until one's p is 0 or 1; the other goes on to meet
the next.  This happens inside blocks of about ``BLOCK`` documents of a source, dealt by hash, so that a hot source
is spread over as many tasks as it has blocks.  A block leaves one fraction at most; those meet in blocks of the
next level of a reduction tree, up to one per source, which a last draw settles.  Words, not documents,
are kept in balance, so that a source's taken words miss its target by less than one document; what is
missing then goes to smaller documents.

Draws are hashes of doc_ids and the seed: reruns agree.  A document of size 0 (null or blank text) takes no words.
The null source is a source of its own.  Repeated rows are documents of their own: rows of equal doc_id, source and text are counted and
numbered from 0, and meet others as their number deals them out.  Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, small, written

BLOCK = 64
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)

#: Rows that one row is turned into at a time; more are dealt out to several tasks.
AT_ONCE = 4096

_ITEM = "struct<h:bigint,doc_id:bigint,text_hash:bigint,number:bigint,w:double,p:double>"


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): words between ASCII white space."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.size(ascii_words(F.col("text"))).cast("long").alias("size"))


def _repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times (a column, which goes), numbered from 0 in ``number``; rows that come more than ``AT_ONCE`` times are dealt out by parts."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = rows.where(F.col(times).between(1, AT_ONCE)).withColumn(number, F.explode(upto(F.col(times)))).drop(times)
    parts = rows.where(F.col(times) > AT_ONCE).withColumn("_part", F.explode(upto(F.ceil(F.col(times) / AT_ONCE))))
    dealt = parts.repartition(F.col("_part"), F.col(times))
    most = F.least(F.lit(AT_ONCE).cast("long"), F.col(times) - F.col("_part") * AT_ONCE)
    many = dealt.withColumn(number, F.explode(F.transform(upto(most), lambda k: k + F.col("_part") * AT_ONCE))).drop(times, "_part")
    return few.unionByName(many)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): ``share`` of all sizes by weight, none above ``most`` times its own size.

    Sources in code point order, null last, take the ``weights`` in turn.  With sources ordered by how soon they
    fill up, the level at which all that are not full stand is found from running sums.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level)
    soon = F.col("cap") / F.col("weight")
    first = leveled.where(F.col("level") <= soon).agg(F.min_by("level", soon).alias("level"))
    return weighed.crossJoin(F.broadcast(first)).select("source", "source_size", "n_docs", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)


def _meet(state: Column, b: Column, level: int, seed: int) -> Column:
    """``state``: (held, out).  The held document meets ``b``; who becomes integral goes to ``out``."""
    a, out = state["held"], state["out"]

    def with_p(item: Column, p: Column) -> Column:
        near = F.when(p < 1e-12, F.lit(0.0)).when(p > 1 - 1e-12, F.lit(1.0)).otherwise(p)
        return F.struct(item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["text_hash"].alias("text_hash"), item["number"].alias("number"), item["w"].alias("w"), near.alias("p"))

    def result(held: Column, done: Column) -> Column:
        return F.struct(held.alias("held"), F.concat(out, F.array(done)).alias("out"))

    a_up, a_down, b_up, b_down = (1 - a["p"]) * a["w"], a["p"] * a["w"], (1 - b["p"]) * b["w"], b["p"] * b["w"]
    up, down = F.least(a_up, b_down), F.least(a_down, b_up)
    goes_up = _uniform(a["h"], b["h"], F.lit(level), F.lit(seed)) * (up + down) < down
    return (
        F.when(a.isNull(), F.struct(b.alias("held"), out.alias("out")))
        .when((a["p"] == 0) | (a["p"] == 1), result(b, a))
        .when(goes_up & (a_up <= b_down), result(with_p(b, b["p"] - up / b["w"]), with_p(a, F.lit(1.0))))
        .when(goes_up, result(with_p(a, a["p"] + up / a["w"]), with_p(b, F.lit(0.0))))
        .when(a_down <= b_up, result(with_p(b, b["p"] + down / b["w"]), with_p(a, F.lit(0.0))))
        .otherwise(result(with_p(a, a["p"] - down / a["w"]), with_p(b, F.lit(1.0))))
    )


def _round_blocks(items: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, block, held, out) from (source, block, item), as a written table."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("held"), F.array().cast(f"array<{_ITEM}>").alias("out"))
    blocks = items.groupBy("source", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    folded = blocks.select("source", "block", F.aggregate("items", start, lambda s, x: _meet(s, x, level, seed)).alias("s"))
    return written(folded.select("source", "block", "s.held", "s.out"), f"rounded{level}")


def _hand_down(done: DataFrame, due: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """``done`` after each source's last miss, of less than one document, has been handed to smaller ones.

    Of each power of two of sizes, two documents stand ready to change sides; largest first, those that fit into what is missing do.
    """
    miss = done.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("got")).join(due, F.col("source").eqNullSafe(F.col("src"))).select("src", (F.col("got") - F.col("due")).alias("miss"))
    near = done.join(small(miss, n_sources), F.col("source").eqNullSafe(F.col("src"))).where("extra = if(miss > 0, 1, 0) and size <= abs(miss)")
    one = ("doc_id", "text_hash", "number")
    order = Window.partitionBy("source", "power").orderBy(F.xxhash64(*one, F.lit(seed + 2)), *one)
    ready = near.withColumn("power", F.floor(F.log2("size"))).withColumn("turn", F.row_number().over(order)).where("turn <= 2")
    lists = ready.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", *one)))).alias("items"), F.abs(F.first("miss")).alias("left"))
    item = "struct<size:bigint,doc_id:bigint,text_hash:bigint,number:bigint>"
    start = F.struct(F.col("left").alias("left"), F.array().cast(f"array<{item}>").alias("out"))
    fits = lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    flips = lists.select(F.col("source").alias("f_source"), F.explode(F.aggregate("items", start, fits)["out"]).alias("f")).select("f_source", *(F.col(f"f.{c}").alias(f"f_{c}") for c in one), F.lit(True).alias("flip"))
    same = F.col("source").eqNullSafe(F.col("f_source"))
    for c in one:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    flips = small(flips, n_sources * 80)
    return done.join(flips, same, "left").select("source", *one, "size", F.when(F.col("flip"), 1 - F.col("extra")).otherwise(F.col("extra")).alias("extra"))


def mixture_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, text_hash, size, source_size, target, copies."""
    counted = document_sizes(docs).groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("times"))
    sizes = written(_repeated(counted, "times", "number"), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    n_sources = targets.count()
    by_source = small(targets.withColumnRenamed("source", "src"), n_sources)
    each = sizes.join(by_source, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    each = each.withColumn("due", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    each = each.withColumn("base", F.floor("due").cast("long")).withColumn("p", F.col("due") - F.floor("due"))
    open_ = (F.col("p") > 1e-12) & (F.col("size") > 0)
    item = F.struct(F.xxhash64("doc_id", "text_hash", "number", F.lit(seed)).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "number", F.col("size").cast("double").alias("w"), "p")
    level0 = each.where(open_).withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK))
    items = level0.select("source", F.pmod(F.xxhash64("doc_id", "text_hash", "number", F.lit(seed + 1)), F.col("blocks")).alias("block"), item.alias("item"))
    blocks = math.ceil((targets.agg(F.max("n_docs")).first()[0] or 0) / BLOCK)
    settled, level = [], 0
    while True:
        rounded = _round_blocks(items, level, seed)
        settled.append(rounded.select("source", F.explode("out").alias("item")))
        held = rounded.where("held is not null").select("source", "block", F.col("held").alias("item"))
        whole = (F.col("item.p") == 0) | (F.col("item.p") == 1)
        settled.append(held.where(whole).select("source", "item"))
        left = held.where(~whole)
        if blocks <= 1:
            drawn = _uniform(F.col("item.h"), F.lit(seed), F.lit(-1)) < F.col("item.p")
            settled.append(left.select("source", F.col("item").withField("p", drawn.cast("double")).alias("item")))
            break
        items = left.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "item")
        blocks, level = math.ceil(blocks / BLOCK), level + 1
    done = settled[0]
    for more in settled[1:]:
        done = done.union(more)
    done = written(done.select("source", "item.doc_id", "item.text_hash", "item.number", F.col("item.w").cast("long").alias("size"), F.col("item.p").cast("long").alias("extra")), "settled")
    done = _hand_down(done, level0.groupBy(F.col("source").alias("src")).agg(F.sum(F.col("p") * F.col("size")).alias("due")), n_sources, seed)
    drawn = done.join(by_source, F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.floor(F.col("target") / F.col("source_size")).cast("long") + F.col("extra")).alias("copies"))
    return each.where(~open_).select("doc_id", "source", "text_hash", "size", "source_size", "target", F.col("base").alias("copies")).unionByName(drawn)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with their own columns, as often as the mix takes them.

    Rows of equal doc_id, source and text stand for each other: the first by all columns as JSON is taken, as often as all of them are.
    """
    taken = mixture_copies(docs, weights, share, most, seed).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = written(taken.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "text_hash", "copies", "rows"))), "taken")
    row = F.struct(*docs.columns)
    each = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_h"))
    same = F.col("_d").eqNullSafe(F.col("_doc_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_text_hash"))
    if not taken.where("_rows > 1").isEmpty():
        each = each.groupBy("_d", "_s", "_h").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    met = each.join(taken.where("_copies > 0"), same).select("_row", "_copies")
    return _repeated(met, "_copies", "_number").select("_row.*")
