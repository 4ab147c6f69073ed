"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds the 64-bit hashes of its distinct word shingles. One hash per shingle fills BINS bins (a bin keeps
its least value; empty bins borrow from bins that a fixed random sequence names). Bands of ROWS bins make bucket keys.
In each bucket the member that meets most others over all buckets is the centre, and only centre-member pairs become
candidates. Every candidate is confirmed on the full sets. Buckets whose members are still in several components get one
more star, and what is then apart is joined exactly, by a prefix filter across components; so stars bound the pairs
without losing links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.llm.common import components, free, mix, slices, written

BINS, ROWS = 128, 4
#: Members of a bucket that one task joins; larger buckets are dealt out over several.
SLICE = 512
#: Buckets that a centre and a member share at least before a star pairs them; of alike sets, 1 in 10^6 shares fewer.
SHARED_BANDS = 2

_SALT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PROBE = np.random.default_rng(20).integers(0, BINS, size=(BINS, 1024))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased; bytes know no other letters and no other white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; fewer words make one shingle, none an empty set."""
    words = [words_of(t) for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    rolled = np.zeros(len(flat), np.uint64)
    for j in range(n):
        rolled[: len(flat) - j] += hashes[j:] * _SALT[j]
    rolled = mix(rolled)
    out, at = [], 0
    for ws in words:
        m = len(ws)
        if m >= n:
            out.append(np.unique(rolled[at : at + m - n + 1]))
        elif m:
            short = hashes[at : at + m] * _SALT[:m]
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True) + _SALT[32 + m : 33 + m]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set; equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first filled bin in its own probing sequence."""
    width = np.uint64(64 - BINS.bit_length() + 1)
    lows = np.arange(BINS, dtype=np.uint64) << width
    at = np.searchsorted(shingles, lows)
    values = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((values >> width) == np.arange(BINS, dtype=np.uint64))
    if not filled.all():
        for tries in (16, _PROBE.shape[1]):
            empty = np.flatnonzero(~filled)
            reach = filled[_PROBE[empty, :tries]]
            found = reach.any(axis=1)
            if tries == 16 and not found.all():
                continue
            first = _PROBE[empty, reach.argmax(axis=1)]
            first[~found] = np.flatnonzero(filled)[0]
            values = values.copy()
            values[empty] = values[first]
            break
    return values


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    return mix((rows * _SALT[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)).view(np.int64)


def _sketches(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    return run


def _full_sets(n: int):
    schema = pa.schema([("sid", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            sets, wanted = shingle_sets(part.column("text").to_pylist(), n), part.column("sid").to_pylist()
            kept = [(w, s.view(np.int64)) for w, s in zip(wanted, sets, strict=True) if len(s) and set_id(s) == w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.list_(pa.int64()))], schema=schema
            )

    return run


class _Sets:
    """Full shingle sets, computed only for the documents that stand in a candidate pair."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, n: int, of: int, least: int):
        self.docs, self.n, self.of, self.least, self.known = docs, n, of, least, None
        self.sketches = sketches

    def take(self, sids: DataFrame) -> None:
        """sids: the column sid of all sets that can ever be asked for; one row stands for each."""
        row = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_hash")
        one = self.sketches.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(row).alias("r"))
        one = written(one.select("sid", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("text_hash")))
        asked = self.docs.join(one.hint("merge"), self.docs.doc_id.eqNullSafe(one.id) & (self.docs.text_hash == one.text_hash)).select("sid", "text")
        self.known = written(asked.mapInArrow(_full_sets(self.n), "sid long, shingles array<long>"))
        if self.known.count() > one.count():  # rows that repeat
            self.known = written(self.known.dropDuplicates(["sid"]))

    def sharing(self, open_sets: DataFrame) -> DataFrame:
        """Pairs (a, b) of open_sets (sid, root) with unlike roots that can be alike enough: an exact prefix filter.

        Ordered from the rarest shingle on, two sets that are alike enough share one of their first
        n - ceil(n * least / of) + 1. Shingles of one set alone come first and make no pair, so a set takes part only with
        what its prefix has beyond them; and a pair counts only if its places leave enough to share.
        """
        asked = written(self.known.join(open_sets, "sid"))
        held = asked.select("sid", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
        counts = held.groupBy("s").agg(F.count("*").alias("sets")).where("sets > 1")
        held = written(held.join(counts, "s"))
        alone, first = F.col("n") - F.count("*"), F.floor(F.col("n") - F.ceil(F.col("n") * self.least / self.of) + 1)
        taking = held.groupBy("sid", "n").agg(alone.alias("alone"), first.alias("first")).where("first > alone").select("sid", "alone", "first")
        place = F.col("alone") + F.row_number().over(Window.partitionBy("sid").orderBy("sets", "s"))
        held = written(held.join(taking, "sid").withColumn("place", place).where("place <= first").select("s", "sid", "root", "n", "place"))
        main = held.groupBy("s", "root").count().groupBy("s").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("roots"))
        main = main.where("roots > 1").select("s", F.col("m.root").alias("main"))
        held = written(held.join(main, "s"))
        a = held.where("root <> main").select("s", F.col("sid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("place").alias("pa"))
        b = held.select("s", F.col("sid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("place").alias("pb"), "main")
        # What two sets can still share from their first common shingle on must be enough.
        rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
        near = rest * (self.of + self.least) >= self.least * (F.col("na") + F.col("nb"))
        once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
        return a.join(b, (a.s == b.s) & (F.col("ra") != F.col("rb")) & near & once).select("a", "b").distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are alike enough."""
        a = self.known.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
        b = self.known.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - F.col("both")
        held = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), "sa", "sb")
        return held.where(self.of * F.col("both") >= self.least * union).select("a", "b").distinct()


def _of_bucket(members: DataFrame, table: DataFrame) -> DataFrame:
    """members with the columns of table, which has one row a bucket (key, size); large buckets are dealt over several tasks."""
    parts = F.ceil(F.col("size") / SLICE).cast("int")
    table = table.withColumn("slice", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
    return members.withColumn("slice", F.pmod(F.xxhash64("sid"), parts).cast("int")).join(table, ["key", "slice"]).drop("slice")


def _star(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's best-connected centre with its members outside the centre's component.

    Members that meet the centre in a single bucket are left to the exact join that follows the stars.
    """
    best = centres.groupBy("key").agg(F.max(F.struct("met", "sid", "root")).alias("c"), F.max("size").alias("size"))
    best = best.select("key", "size", F.col("c.sid").alias("a"), F.col("c.root").alias("ra"))
    apart = F.col("ra").isNull() if "root" not in members.columns else F.col("ra") != F.col("root")
    met = _of_bucket(members, best).where(apart & (F.col("a") != F.col("sid")))
    return met.groupBy("a", F.col("sid").alias("b")).count().where(F.col("count") >= SHARED_BANDS).drop("count")


def _grouped(docs: DataFrame, shingle: int, least: int, of: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row (doc_id, text_hash, n, sid), and (sid, root) of the sets that are linked with others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    made = docs.mapInArrow(_sketches(shingle), "doc_id long, text_hash long, n long, sid long, bands array<long>")
    sketches = written(made)
    named = sketches.where("sid is not null")
    # Distinct members of each bucket; copies meet before the shuffle.
    members = written(named.select("sid", F.explode("bands").alias("key")).distinct())
    sizes = written(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    # A merge join at every size, in which adaptive execution splits buckets that are too large for a task.
    members = written(members.join(sizes.hint("merge"), "key"))
    met = members.groupBy("sid").agg(F.sum("size").alias("met"))
    members = written(members.join(met, "sid"))
    sets = _Sets(docs, named, shingle, of, least)
    sets.take(members.select("sid").distinct())
    links = written(sets.linked(written(_star(members, members.select("key", "size", "sid", "met", F.lit(None).cast("long").alias("root"))))))
    for last in (False, True):
        roots = components(links)
        left = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("size")).where("low <> high").select("key", "size")
        left = written(_of_bucket(left, mixed))
        if last:
            fresh = sets.sharing(left.select("sid", "root").distinct())
        else:
            # One more star in each bucket, from the best-connected member outside its largest component.
            main = left.groupBy("key", "root").agg(F.count("*").alias("count"), F.max("size").alias("size"))
            main = main.groupBy("key").agg(F.max(F.struct("count", "root")).alias("m"), F.max("size").alias("size")).select("key", "size", F.col("m.root").alias("main"))
            fresh = _star(left, _of_bucket(left, main).where("root <> main"))
        links = links.union(written(sets.linked(written(fresh))))
    return sketches.drop("bands"), components(links).withColumnRenamed("node", "sid")


def near_duplicates(docs: DataFrame, shingle: int = 4, least: int = 80, of: int = 100) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id (least doc_id of the group), kept; a row for each row.

    docs needs doc_id and text; other columns are ignored. Two sets are linked if of * |both| >= least * |either|, always
    confirmed on full sets. Null and blank texts have an empty set and are linked with nothing. Rows with equal sets are
    one node, so groups of exact copies, of any size, cost one node. Rows that repeat a doc_id are each judged by their
    own text. Rows without doc_id are linked like others, but a group's component_id is null only if none of its rows has
    a doc_id; such a row is kept only then. An empty table gives no rows.
    """
    sketches, roots = _grouped(docs, shingle, least, of)
    named = sketches.where("sid is not null")
    nodes = named.groupBy("sid").agg(F.min("doc_id").alias("least"))
    grouped = nodes.join(roots, "sid").groupBy("root").agg(F.min("least").alias("least"))
    lesser = roots.join(grouped, "root").select("sid", F.col("least").alias("linked"))
    final = nodes.join(lesser, "sid", "left").select("sid", F.least("least", "linked").alias("group_id"))
    rows = named.join(final, "sid").select("doc_id", F.col("n").alias("n_shingles"), F.col("group_id").alias("component_id"))
    alone = sketches.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """docs, with all their columns, with one row of each group of near duplicates: that of the least doc_id.

    Rows without doc_id stand behind all others; of rows with one doc_id that of the least text hash stays, and of rows
    that are equal in both one. Rows whose text has no words all stay. Groups are those of near_duplicates.
    """
    sketches, roots = _grouped(docs, shingle, least, of)
    named = sketches.where("sid is not null").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    row = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_hash")
    texts = written(named.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times")))
    keepers = written(texts.groupBy("root").agg(F.min(row).alias("keeper"), F.sum("times").alias("rows")).where("rows > 1"))
    judged = texts.join(keepers.hint("merge"), "root").withColumn("stays", row == F.col("keeper"))
    id_, hash_ = free(docs.columns, "id"), free(docs.columns, "text_hash")
    judged = written(judged.where("not stays or times > 1").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), "stays"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    # A merge join at every size: what goes grows with the documents.
    left = docs.join(judged.drop("stays").hint("merge"), same, "left_anti")
    again = judged.where("stays")
    if again.limit(1).count():
        # Equal rows: the first in the order of all their columns.
        held = docs.join(again.drop("stays"), same, "left_semi").withColumn(hash_, F.xxhash64("text"))
        place = free(held.columns, "place")
        order = Window.partitionBy("doc_id", hash_).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
        left = left.union(held.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns))
    return left
