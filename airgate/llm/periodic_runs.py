"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch of words with smallest period q that holds it at least four times. For each power of two B every
text is cut into blocks of B words. A run of period q, where 2 B - 1 <= 3 q < 4 B - 1, holds a whole block that recurs q
words later inside the run; so each block asks where it next occurs in the window of those distances behind it, cut in two
halves. In half a window three or more occurrences of a block are an arithmetic progression whose difference is the block's
own period; then only the two distances that bring the ends of that shorter repetition together can be a longer period, so
a half gives four candidate periods at most. Candidates are confirmed, and stretched to their full length, by longest common
extensions.

What answers the questions: ranks of all stretches of 1, 2, 4, ... words by doubling (the extensions compare them, and they
give a block's range in the suffix array), and a wavelet tree over the suffix array, in its matrix form, for the range
successor: the least position, not before a given one, within a range of the array. Words of different texts count as
different, so many short texts are one sequence and every step is an array operation over all their blocks.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from airgate.llm.common import SPACE, free, slices

#: Words that are searched together; a longer text is searched alone.
TOGETHER = 100_000
#: A run is at least so long, and holds its period at least so often. The windows rest on the latter.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Factors:
    """Ranks of the stretches of 1, 2, 4, ... items from every position on, up to the length at which all differ.

    A rank is the place in the suffix array at which the suffixes that begin so start. ranks[k] has one for each position;
    sizes[k] says how many positions share it (0 for a position that had become the only one before).
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        counts = np.bincount(ids)
        rank = (np.cumsum(counts) - counts)[ids]
        size = counts[ids]
        self.ranks, self.sizes, self.n = [rank.astype(np.int32)], [size.astype(np.int32)], n
        active, h = np.flatnonzero(size > 1), 1
        while active.size:
            ahead = active + h
            after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + after
            order = np.argsort(key)
            key, at = key[order], active[order]
            old = rank[at]
            places = np.arange(len(at))
            begins = np.concatenate(([True], key[1:] != key[:-1]))
            outer = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), places, 0))
            heads = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            size = np.diff(np.append(heads, len(at)))[group]
            rank = rank.copy()
            rank[at] = old + heads[group] - outer
            sizes = np.zeros(n, np.int32)
            sizes[at] = size
            self.ranks.append(rank.astype(np.int32))
            self.sizes.append(sizes)
            active = np.sort(at[size > 1])
            h *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items agree from a and from b on (a < b)."""
        x, y = a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (y + (1 << k) <= self.n) & (self.ranks[k][np.minimum(x, self.n - 1)] == self.ranks[k][np.minimum(y, self.n - 1)])
            x += same.astype(np.int64) << k
            y += same.astype(np.int64) << k
        return x - a

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items agree just before a and just before b (a < b)."""
        x, y = a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (x >= 1 << k) & (self.ranks[k][np.maximum(x - (1 << k), 0)] == self.ranks[k][np.maximum(y - (1 << k), 0)])
            x -= same.astype(np.int64) << k
            y -= same.astype(np.int64) << k
        return a - x


class Successor:
    """A wavelet matrix over distinct numbers 0, 1, ...: the least one, not under a given one, in a range of the sequence."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            values = np.concatenate((values[zero], values[~zero]))

    def of(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each range [left, right) the least value of at least `least`; n if there is none."""
        x, y, under = left.copy(), right.copy(), np.zeros(len(left), np.int64)
        for k, zeros in enumerate(self.zeros):
            high = (least >> (self.bits - 1 - k)) & 1 == 1
            zx, zy = zeros[x].astype(np.int64), zeros[y].astype(np.int64)
            under += np.where(high, zy - zx, 0)
            x, y = np.where(high, zeros[-1] + x - zx, zx), np.where(high, zeros[-1] + y - zy, zy)
        under = np.where(least >= self.n, right - left, under)
        found = under < right - left
        x, y, value = left.copy(), right.copy(), np.zeros(len(left), np.int64)
        for k, zeros in enumerate(self.zeros):
            zx, zy = zeros[x].astype(np.int64), zeros[y].astype(np.int64)
            high = under >= zy - zx
            under = np.where(high, under - (zy - zx), under)
            x, y = np.where(high, zeros[-1] + x - zx, zx), np.where(high, zeros[-1] + y - zy, zy)
            value += high.astype(np.int64) << (self.bits - 1 - k)
        return np.where(found, value, self.n)


class Occurrences:
    """Where a stretch of 2^k items that starts at a position occurs next, by range successor over the suffix array."""

    def __init__(self, factors: Factors):
        self.factors = factors
        #: Positions whose first two items recur; no other stretch of two or more occurs twice. Only these are held.
        self.held = np.flatnonzero(factors.sizes[1] > 1)
        place = np.full(factors.n, -1, np.int64)
        place[factors.ranks[-1][self.held]] = np.arange(len(self.held))
        present = place >= 0
        #: How many held suffixes come before each place of the suffix array, held positions before each position.
        self.before = np.concatenate(([0], np.cumsum(present)))
        self.tree = Successor(place[present])
        self.upto = np.concatenate(([0], np.cumsum(factors.sizes[1] > 1)))
        self.positions = np.append(self.held, 2 * factors.n + 1)

    def next(self, k: int, block: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first occurrence of the stretch at `block` that starts at `least` or later; beyond the end if there is none."""
        low = self.factors.ranks[k][block].astype(np.int64)
        high = low + self.factors.sizes[k][block]
        return self.positions[self.tree.of(self.before[low], self.before[high], self.upto[np.minimum(least, self.factors.n)])]


def candidates(occurrences: Occurrences, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2^k items, cut from the start of each text on, and distances at which they may begin to repeat."""
    factors, size = occurrences.factors, 1 << k
    again = np.flatnonzero(factors.sizes[k] > 1)
    block = again[(again - starts[np.searchsorted(starts, again, "right") - 1]) % size == 0]
    # Distances (2 B - 1) / 3 <= q < (4 B - 1) / 3, in two halves.
    low, high = -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3)
    middle = low + (high - low + 1) // 2
    at, found = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        at.append(i)
        found.append(j - i)

    i, least = block, block + low
    while i.size:
        one = occurrences.next(k, i, least)
        inside = one < i + high
        i, one = i[inside], one[inside]
        if not i.size:
            break
        end = np.where(one < i + middle, i + middle, i + high)
        keep(i, one)
        two = occurrences.next(k, i, one + 1)
        least = np.maximum(end, np.minimum(two, i + high))
        more = two < end
        a, first, second, stop = i[more], one[more], two[more], end[more]
        keep(a, second)
        three = occurrences.next(k, a, second + 1)
        least[more] = np.maximum(stop, np.minimum(three, a + high))
        many = three < stop
        a, first, step = a[many], first[many], second[many] - first[many]
        # The block has period `step`: it and its occurrences lie in repetitions whose ends must come together.
        ends = [p + step + factors.ahead(p, p + step) for p in (a, first)]
        begins = [p - factors.behind(p, p + step) for p in (a, first)]
        for near, far in (ends, begins):
            fits = (far - near >= low) & (far - near < high)
            keep(a[fits], a[fits] + (far - near)[fits])
        # The second half is asked for unless the next occurrence is known to lie beyond it.
        on = least < i + high
        i, least = i[on], least[on]
    return (np.concatenate(at), np.concatenate(found)) if at else (block[:0], block[:0])


def find_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of every run in the sequence ids, by start, then period.

    starts are the places at which texts begin; no two texts may share an id.
    """
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    factors = Factors(np.asarray(ids, np.int64))
    if len(factors.ranks) < 2 or not (factors.sizes[1] > 1).any():
        return none, none, none
    occurrences, rows = Occurrences(factors), []
    for k in range(1, len(factors.ranks)):
        at, period = candidates(occurrences, starts, k)
        start = at - factors.behind(at, at + period)
        length = at + period + factors.ahead(at, at + period) - start
        good = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        rows.append(np.stack([start[good], length[good], period[good]], 1))
    # A stretch that also has a shorter period has it over its whole length: the shortest stays.
    start, length, period = np.concatenate(rows).T
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.zeros(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    ids, starts, base, total = [], [], 0, 0
    for words in texts:
        starts.append(total)
        known: dict[bytes, int] = {}
        ids.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)) + base)
        base += len(known)
        total += len(words)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin = np.array(starts, np.int64)
    start, length, period = find_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), begin)
    text = np.searchsorted(begin, start, "right") - 1
    for t, s, m, q in zip(text.tolist(), (start - begin[text]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[t].append((s, m, q))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, keep))


def _annotate(schema: pa.Schema, at: int):
    def run(batches):
        for part in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(at).to_pylist()]
            runs, first = [], 0
            while first < len(texts):
                last, held = first + 1, len(texts[first])
                while last < len(texts) and held + len(texts[last]) <= TOGETHER:
                    held += len(texts[last])
                    last += 1
                runs += _search(texts[first:last])
                first = last
            kind = schema.field("runs").type
            found = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs], kind)
            once = pa.array([_collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, runs, strict=True)], pa.string())
            sizes = pa.array([len(w) for w in texts], pa.int64())
            kept = [part.column(i) for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, sizes, found, once], schema=schema)

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and collapsed, the text with each run told once.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0, compared as they are. A run has its smallest period q, at least
    max(6, 4 q) words and no neighbour that extends it; a word is left out of collapsed if a run holds it after the run's
    first q words, and words that stay are joined by one space. Each row is judged by its own whole text, where it is read:
    repeated rows and null keys alike. Null, empty and blank texts have no words, no runs and an empty collapsed text. Other
    columns are ignored; an empty table gives no rows. Memory is about 12 log2(n) bytes a word of the texts searched
    together: TOGETHER words, or one longer text.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("key_", to_arrow_type(docs.schema[key].dataType)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    made = rows.mapInArrow(_annotate(schema, 1), f"key_ {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return made.withColumnRenamed("key_", key)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, in a tenth of the documents with a tail that repeats: the texts that op13_periodic_runs searches.

    With h = crc32(doc_id in decimal) and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id changes nothing.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    held = held.withColumn("_g", F.when(h % 10 == 0, g))
    words = F.when(F.col("_g").isNotNull(), F.array_remove(F.split("text", SPACE), ""))
    held = held.withColumn("_w", words).withColumn("_n", F.size("_w"))
    a = F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int"))
    held = held.withColumn("_a", a)
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    held = held.withColumn("_p", p)
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times))
    made = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return held.select("doc_id", F.when(F.col("_a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The run with greatest length, of those the one with smallest start, then period."""
    return F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r.length).alias("m"), r.start.alias("s"), r.period.alias("q")))), 1)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    top = free(found.columns, "_top")
    held = found.withColumn(top, F.when(F.size("runs") > 0, _longest(F.col("runs"))))
    length, period = -F.col(f"{top}.m"), F.col(f"{top}.q")
    return held.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col(f"{top}.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


#: The words of every text with its repeated tail, then runs by brute force: stretches of equal words q apart, for every q.
ORACLE = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_sort(list({'n': n, 'v': list_reduce(list_prepend(n::BIGINT, CAST(range(8) AS BIGINT[])),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))})) AS t FROM range(256) r(n)
), rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w0 FROM documents
), hashed AS (
  SELECT rid, doc_id, w0, len(w0)::BIGINT AS n,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1].v))) AS h FROM rows_, crc_table
), planned AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed
), sized AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planned
), words_ AS MATERIALIZED (
  SELECT rid, doc_id, n, i, w0[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM sized)
), matched AS (
  SELECT x.rid, y.i - x.i AS q, x.i AS i, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island
  FROM words_ x JOIN words_ y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS m FROM matched GROUP BY rid, q, island
), found AS MATERIALIZED (
  SELECT rid, s, m, min(q) AS q FROM stretches WHERE m >= 6 AND m >= 4 * q GROUP BY rid, s, m
), told AS (
  SELECT rid, count(*)::BIGINT AS n_runs, first({'s': s, 'm': m, 'q': q} ORDER BY m DESC, s, q) AS top,
    string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM found GROUP BY rid
), kept AS (
  SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM words_ w
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.rid = w.rid AND w.i >= f.s + f.q AND w.i < f.s + f.m) GROUP BY w.rid
)
SELECT r.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.m::BIGINT AS length, top.q::BIGINT AS period,
  (1000 * top.m // top.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.t, '')) AS collapsed_sha256, len(r.w0)::BIGINT AS n_words
FROM rows_ r LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
