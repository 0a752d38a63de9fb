"""Operator 5, benchmark decontamination: SimHash of item-sized windows, in DataFrame functions alone.

A window of a document is as long, in words, as the item it is held against.  At every place, for every
length of items, there is a window; it gets a fingerprint if the weights of its shingles that stand in items of
that length add up to what the lightest of these needs, since all others fall short of the similarity for
certain.  The 128-bit fingerprints, of weighted shingles, meet those of items of their length in a
multi-index of 13 blocks of 9 or 10 bits, where items stand under every value at most two bits away: by
the pigeonhole principle no pair within 38 bits is missed.  What is within that radius is verified by the exact
similarity of weighted shingles, the weight being the rarity among items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, table

SHINGLE, SIMILARITY = 5, 0.8
#: First bit and bits of each block; a pair within RADIUS differs in at most two bits of some block, since 13 blocks with three each are 39.
BLOCKS = tuple((10 * b, 10) for b in range(11)) + ((110, 9), (119, 9))
RADIUS, FLIPS = 3 * len(BLOCKS) - 1, 2
#: Item shingles, and keys of rows that hold one, that are broadcast at most; beyond it the joins shuffle.
SENT_SHINGLES, SENT_KEYS = 500_000, 500_000

LONGS = "array<bigint>"


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "), " ", -1), lambda w: w != "")


def _with_shingles(df: DataFrame, short: tuple[int, ...] = ()) -> DataFrame:
    """Adds n (words) and s (a hash of each run of five words, in order; empty for shorter texts) in place of text, and for each length in ``short`` (under five) the runs of so many words as g1, g2, ..."""
    none = F.array().cast(LONGS)

    def pair(a: str, b: str, shift: int) -> Column:
        n = F.size(b) - shift
        return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))).otherwise(none)

    df = held(df, h=F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    df = held(df, n=F.size("h"), h2=pair("h", "h", 1))
    df = held(df, h4=pair("h2", "h2", 2))
    runs = {1: F.col("h"), 2: F.col("h2"), 3: pair("h2", "h", 2), 4: F.col("h4")}
    tagged = lambda k: F.transform(runs[k], lambda x: F.xxhash64(x, F.lit(k)))
    grams = {f"g{k}": tagged(k) for k in short}
    return held(df, s=pair("h4", "h", 4), **grams).drop("h", "h2", "h4")


def fingerprint(shingles: Column) -> tuple[Column, Column]:
    """128 bits as two longs: the signs of sums, over shingles (structs of x and weight), of the weight with the sign of each bit of their two hashes."""

    def half(seed: int) -> Column:
        hashes = F.transform(shingles, lambda e: F.struct(F.xxhash64(e["x"], F.lit(seed)).alias("h"), e["weight"].alias("w")))
        sums = F.aggregate(
            hashes,
            F.array_repeat(F.lit(0.0), 64),
            lambda acc, e: F.transform(acc, lambda v, b: v + F.when(F.getbit(e["h"], b) == 1, e["w"]).otherwise(-e["w"])),
        )
        return F.aggregate(F.transform(sums, lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(v))

    return half(1), half(2)


def _block(start: int, bits: int) -> Column:
    """So many bits from ``start`` on, of the fingerprint in the columns f1 (bits 0 to 63) and f2."""
    low = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << n) - 1))
    if start >= 64:
        found = F.shiftrightunsigned("f2", start - 64).bitwiseAND(F.lit((1 << bits) - 1))
    elif start + bits <= 64:
        found = F.shiftrightunsigned("f1", start).bitwiseAND(F.lit((1 << bits) - 1))
    else:
        found = F.shiftrightunsigned("f1", start).bitwiseOR(F.shiftleft(low("f2", start + bits - 64), 64 - start))
    return found.cast("int")


def _flips(bits: int) -> list[int]:
    """What a block's value is xored with: nothing, one bit, two bits."""
    one = [1 << k for k in range(bits)]
    return [0, *one, *[a | b for k, a in enumerate(one) for b in one[k + 1 :]]]


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n, s of items with a word; those under five words are one run of all their words; equal texts under one id are one item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").dropDuplicates()
    df = _with_shingles(items.withColumn("item", F.xxhash64("item_id", "text")), (1, 2, 3, 4))
    s = F.col("s")
    for k in (1, 2, 3, 4):
        s = F.when(F.col("n") == k, F.col(f"g{k}")).otherwise(s)
    return df.select("item", "item_id", "n", s.alias("s")).where(F.size("s") > 0)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item whose best window is similar enough: doc_id, key, item_id, start, n_words, similarity.

    ``key`` is a hash of the text, so that rows that share a doc_id are told apart; start and n_words
    count words (runs of letters and digits) from 0.  Null and empty texts have no window, null and
    empty items match nothing; an item under five words is found where it stands word for word.
    Repeated rows give one result; null ids are a document's id like others; an empty table gives an empty
    result; further columns are not read.  A document shorter than an item is one window.
    """
    items = cut(_items(benchmark), "items")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    send = F.broadcast if n_shingles <= SENT_SHINGLES else (lambda d: d)
    short = tuple(r.n for r in items.where("n < 5").select("n").distinct().orderBy("n").collect())  # four at most
    each = items.select("item", "n", F.explode(F.array_distinct("s")).alias("x"))
    weights = cut(each.groupBy("x").agg(F.log1p(F.lit(float(n_items)) / F.count("*")).alias("weight")), "item-weights")
    own = each.join(send(weights), "x").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("x", "weight"))).alias("pairs"))
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["weight"])
    items = cut(own.join(items.select("item", "item_id", F.col("n").alias("length")), "item").withColumn("item_sum", total(F.col("pairs"))), "weighted-items")
    least = items.groupBy("length").agg((F.min("item_sum") * similarity - 1e-9).alias("least"))
    marks = items.select("length", F.explode("pairs").alias("e")).select("length", "e.x", "e.weight").distinct()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    # shingles of a document that stand in items, then the windows that hold them, with the weights that they hold
    runs = F.col("s") if not short else F.concat("s", *[f"g{k}" for k in short])
    sizes = [F.size("s").alias("n_s"), *[F.size(f"g{k}").alias(f"n_g{k}") for k in short]]
    at = F.col("pos")
    for k, n in enumerate(short):
        before = F.col("n_s")
        for j in short[:k]:
            before = before + F.col(f"n_g{j}")
        at = F.when(F.col("length") == n, F.col("pos") - before).otherwise(at)
    spread = _with_shingles(source, short).select("doc_id", "key", "n", *sizes, F.posexplode(runs).alias("pos", "x"))
    met = spread.join(send(marks), "x").select("doc_id", "key", "n", "length", "weight", at.alias("at"))
    first = F.greatest(F.lit(0), F.col("at") - F.greatest(F.lit(0), F.col("length") - SHINGLE))
    starts = F.when(F.col("n") < F.col("length"), F.array(F.lit(0))).otherwise(F.sequence(first, F.least("at", F.col("n") - F.col("length"))))
    sums = met.select("doc_id", "key", "length", F.explode(starts).alias("start"), "weight").groupBy("doc_id", "key", "length", "start").agg(F.sum("weight").alias("met"))
    # repeated rows add up to more than one of them: that lets windows pass, and stops none
    windows = cut(sums.join(F.broadcast(least) if n_items <= SENT_SHINGLES else least, "length").where("met >= least").select("doc_id", "key", "start", "length"), "windows")

    hit = windows.select("doc_id", "key").distinct()
    hit = hit.select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    again = source.join(F.broadcast(hit) if hit.count() <= SENT_KEYS else hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "key"])
    again = _with_shingles(again, short).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "s", *[f"g{k}" for k in short])
    window = windows.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    s = F.slice("s", F.col("start") + 1, F.greatest(F.lit(1), F.col("length") - SHINGLE + 1))
    for k in short:
        s = F.when(F.col("length") == k, F.slice(f"g{k}", F.col("start") + 1, F.lit(1))).otherwise(s)
    cols = ["doc_id", "key", "start", "length"]
    sides = window.select(*cols, F.explode(F.array_distinct(s)).alias("x")).join(send(weights), "x", "left")
    sides = sides.withColumn("weight", F.coalesce("weight", F.log1p(F.lit(float(n_items)))))
    window = sides.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("x", "weight"))).alias("shingles"))
    f1, f2 = fingerprint(F.col("shingles"))
    window = cut(window.withColumn("f1", f1).withColumn("f2", f2), "fingerprints")

    f1, f2 = fingerprint(F.col("pairs"))
    index = held(items.select("item", "length", "pairs"), f1=f1, f2=f2)
    blocks = lambda near: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(*at).alias("v"), *([F.array(*map(F.lit, _flips(at[1]))).alias("near")] if near else [])) for b, at in enumerate(BLOCKS)]))
    index = index.select("item", "length", F.col("f1").alias("g1"), F.col("f2").alias("g2"), blocks(True).alias("e")).select("item", "length", "g1", "g2", "e.b", "e.v", F.explode("e.near").alias("flip"))
    index = cut(index.select("item", "length", "g1", "g2", "b", F.col("v").bitwiseXOR(F.col("flip")).alias("v")), "multi-index")
    probes = window.select(*cols, "f1", "f2", blocks(False).alias("e")).select(*cols, "f1", "f2", "e.b", "e.v")
    pairs = probes.join(F.broadcast(index) if n_items * sum(len(_flips(n)) for _, n in BLOCKS) <= SENT_SHINGLES else index, ["length", "b", "v"])
    distance = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
    pairs = cut(pairs.where(distance <= RADIUS).select(*cols, "item").distinct(), "within-radius")

    # exact similarity: weights of shared shingles over weights of all
    same = F.expr("p.doc_id <=> w.doc_id AND p.key = w.key AND p.start = w.start AND p.length = w.length")
    both = pairs.alias("p").join(window.alias("w"), same).select("p.*", "w.shingles").join(send(items.drop("length")), "item")
    held_by = F.filter("pairs", lambda e: F.array_contains(F.transform("shingles", lambda x: x["x"]), e["x"]))
    scored = held(held(both, shared=held_by), both_sum=total(F.col("shared")), window_sum=total(F.col("shingles")))
    scored = scored.withColumn("similarity", F.round(F.col("both_sum") / (F.col("window_sum") + F.col("item_sum") - F.col("both_sum")), 6))
    best = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("best"))
    return best.select("doc_id", "key", "item_id", (-F.col("best.s")).alias("start"), F.col("best.length").alias("n_words"), "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns."""
    found = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("leak_doc"), F.col("key").alias("leak_key")).distinct(), "leaks")
    sent = F.broadcast(found) if found.count() <= SENT_KEYS else found
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(sent, docs["doc_id"].cast("long").eqNullSafe(F.col("leak_doc")) & (key == F.col("leak_key")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
