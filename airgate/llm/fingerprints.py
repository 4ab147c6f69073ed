"""Document fingerprints by consistent weighted sampling: equal components are as likely as two texts' generalised Jaccard.

A text is a bag of words weighted by their counts. For each of SAMPLES samples a word draws r and c from Gamma(2, 1) and b
from U(0, 1), all from hashes of the word and the sample; with t = floor(ln(weight) / r + b) it stands at
ln(c) - r * (t - b + 1), and the lowest word wins. That value depends on the word and t alone, so it serves as the
signature's component: two texts agree in it just if they chose the same word at the same t.

Native: DataFrame functions only, and for each text one hash aggregation over its words, without a shuffle of words. A text
and its edited text are one bag with two weights a word, so that they share the draws.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgate.llm.common import SPACE, shared_folder, written

#: Components of a signature; a likeness of p is met with a standard error of sqrt(p * (1 - p) / SAMPLES), 0.0625 at most.
SAMPLES = 64
#: Samples that one aggregation draws; compiled aggregations hold up to 100 columns.
GROUP = 32
#: What tells rows apart and orders them: without doc_id last, then doc_id downwards, then the hash of the text.
KEY = ["nil", "down", "hash"]


def _uniform(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) * F.lit(1.0 / 0x200000)


def _draw(base: Column, k: int) -> Column:
    """64 bits for the k-th draw of a word and group, whose hash is `base`: one hash of one number."""
    return F.xxhash64(base.bitwiseXOR(F.lit((k + 1) * 0x9E3779B97F4A7C15 % (1 << 63))))


def _place(base: Column, log_weight: Column, sample: int) -> Column:
    one, two = _draw(base, 2 * sample), _draw(base, 2 * sample + 1)
    r = -F.log(_uniform(one, 0) * _uniform(one, 21))
    c = -F.log(_uniform(two, 0) * _uniform(two, 21))
    b = _uniform(one, 42)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b + 1)


def signatures(texts: DataFrame, keys: list[str], sides: tuple[str, ...] = ("text",), samples: int = SAMPLES) -> DataFrame:
    """keys and sig_<side>, an array of `samples` ints, for every row; rows with equal keys count as one text.

    Each side is a text column; a side without words has a null signature, and a row without any has no row. If texts is
    already dealt by one of the keys, nothing is shuffled. Samples are drawn in groups of GROUP, a row each, so that an
    aggregation has few enough columns to be compiled.
    """
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(s).alias("t")) for k, s in enumerate(sides)]))
    words = texts.select(*keys, told.alias("x")).select(*keys, F.col("x.side").alias("side"), F.explode(F.split(F.lower("x.t"), SPACE)).alias("word"))
    # The logarithm of no occurrence is null, and so is the place that it gives.
    weights = [F.log(F.count(F.when(F.col("side") == k, 1)).cast("double")).alias(f"w{k}") for k in range(len(sides))]
    bags = words.where("word <> ''").groupBy(*keys, F.xxhash64("word").alias("word")).agg(*weights)
    groups, size = -(-samples // GROUP), min(GROUP, samples)
    bags = bags.withColumn("group", F.explode(F.array(*[F.lit(g) for g in range(groups)]))).withColumn("base", F.xxhash64("word", "group"))
    least = [F.min(_place(F.col("base"), F.col(f"w{k}"), s)).alias(f"m{s}_{k}") for s in range(size) for k in range(len(sides))]
    made = bags.groupBy(*keys, "group").agg(*least)
    part = lambda k: F.when(F.col(f"m0_{k}").isNotNull(), F.array(*[F.hash(f"m{s}_{k}") for s in range(size)])).alias(f"s{k}")
    whole = F.struct(*[part(k) for k in range(len(sides))])
    made = made.groupBy(*keys).agg(*[F.max(F.when(F.col("group") == g, whole)).alias(f"g{g}") for g in range(groups)])
    sig = lambda k: F.slice(F.concat(*[F.col(f"g{g}.s{k}") for g in range(groups)]), 1, samples)
    return made.select(*keys, *[sig(k).alias(f"sig_{s}") for k, s in enumerate(sides)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal components; texts without words are alike to each other and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def as_text(sig: Column) -> Column:
    """Eight hex digits a component; the empty text for texts without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), ""), F.lit(""))


def followed(ids: DataFrame, parts: int) -> DataFrame:
    """ids (KEY, ...) with `next`, the KEY of the row that follows in the order of KEY, after the last the first.

    Rows are dealt by range and looked up within their range; of each range only its first key reaches the driver.
    """
    place = F.struct(*KEY)
    dealt = written(ids.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id()))
    firsts = {r["_part"]: r["f"] for r in dealt.groupBy("_part").agg(F.min(place).alias("f")).collect()}
    if not firsts:
        return dealt.withColumn("next", place).drop("_part")
    kinds = dict(dealt.select(*KEY).dtypes)
    whole = min(tuple(f) for f in firsts.values())
    after = [min((tuple(f) for p, f in firsts.items() if p > part), default=whole) for part in range(parts)]
    beyond = F.array(*[F.struct(*[F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(KEY, f, strict=True)]) for f in after])
    inside = F.lead(place).over(Window.partitionBy("_part").orderBy(*KEY))
    return dealt.withColumn("next", F.coalesce(inside, F.element_at(beyond, F.col("_part") + 1))).drop("_part")


def bucketed(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """df, written to the shared folder in buckets by keys and read again: joins on the keys don't deal it anew.

    The table has a name in the session's catalog; its files go when the session ends.
    """
    spark, name = df.sparkSession, f"airgate_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/airgate/{name}"
    df.write.bucketBy(parts, *keys).option("path", path).format("parquet").saveAsTable(name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.table(name)


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, in which the last half comes from the next document.

    The next document is the one with the next lower doc_id, after the lowest the highest; a lone document follows itself.
    Rows without doc_id come after all others, rows with one doc_id in the order of their texts' hashes, equal rows one
    after the other; every row has its result. floor(n_chars / 2) code points are replaced by the next document's first as
    many, or by all if it has fewer. Null texts are empty; a text without words has the empty fingerprint. Texts of any
    length are read whole. Other columns are ignored. An empty table gives no rows.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc.isNull().cast("int").alias("nil"), F.bitwise_not(F.coalesce(doc, F.lit(0))).alias("down"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ids = written(rows.select(*KEY, F.char_length("text").cast("long").alias("n")))
    order = followed(ids, parts)
    repeated = ids.groupBy(*KEY).count().where("count > 1").limit(1).count() > 0
    if repeated:
        # Equal rows are one text here; all but the last of them are followed by themselves.
        rows = rows.groupBy(*KEY).agg(F.min("text").alias("text"))
        order = order.groupBy(*KEY, "n", "next").agg(F.count("*").cast("int").alias("times"))
    else:
        order = order.withColumn("times", F.lit(1))
    order = written(order.withColumn("again", (F.struct(*KEY) == F.col("next")) & F.lit(repeated)))
    to = F.struct(*KEY, "again").alias("to")
    give = order.select(*[F.col(f"next.{c}").alias(c) for c in KEY], to, F.floor(F.col("n") / 2).cast("int").alias("half"))
    # Each text is dealt by key once; what the next document gives travels, cut, to the one it is given to.
    heads = rows.join(give.hint("shuffle_hash"), KEY).select("to.*", "half", F.expr("substring(text, 1, half)").alias("head"))
    pairs = rows.join(heads, KEY).withColumn("changed", F.expr("concat(substring(text, 1, char_length(text) - half), head)"))
    sigs = signatures(pairs.select(*KEY, "again", "text", "changed"), [*KEY, "again"], ("text", "changed"), samples)
    facts = pairs.select(*KEY, "again", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"))
    # Both lie dealt by KEY; `again` is compared as a condition, so that it is no key of the join, which would deal them anew.
    sigs = sigs.withColumnsRenamed({c: f"s_{c}" for c in [*KEY, "again"]})
    same = F.col("again").cast("int") - F.col("s_again").cast("int") == 0
    made = facts.join(sigs, [F.col(c) == F.col(f"s_{c}") for c in KEY] + [same], "left")
    # Kept in buckets by KEY, so that signatures are dealt no more: only what the next document says travels, to the one before.
    made = bucketed(made.select(*KEY, "again", "edited_sha256", F.col("sig_text").alias("own"), F.col("sig_changed").alias("changed")), KEY, parts)
    owns = made.select(*KEY, F.col("own").alias("next_own"))
    if repeated:
        owns = owns.groupBy(*KEY).agg(F.first("next_own").alias("next_own"))
    asks = order.select(*[F.col(c).alias(f"to_{c}") for c in KEY], F.col("again").alias("to_again"), "n", "times", *[F.col(f"next.{c}").alias(c) for c in KEY])
    told = owns.hint("merge").join(asks, KEY).drop(*KEY)
    out = made.hint("merge").join(told, [F.col(c) == F.col(f"to_{c}") for c in KEY] + [F.col("again").cast("int") - F.col("to_again").cast("int") == 0])
    out = out.select(
        F.when(F.col("nil") == 0, F.bitwise_not("down")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        "times",
    )
    return (out.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))) if repeated else out).drop("times")
