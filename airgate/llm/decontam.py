"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items by block-max WAND.

Impacts are divided by their item's own score, so one threshold serves all items: the share of the item's BM25 mass that a
passage holds. The index is cut into blocks of items, alike in length; each term keeps its highest impact in each block. A
passage's block maxima are summed first, for all its blocks at once and without the commonest terms, whose joint share in
a block is known; only blocks that can still reach the threshold are opened, and WAND goes through their items. What it
retrieves is verified by the share of the item's question and of its answer that stands in the passage, in runs of SHINGLE
words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import filtered, slices, written

K1, B = 1.2, 0.75
#: Share of an item's BM25 score that a passage must hold, and share of its question's and its answer's word runs.
LEAST_SCORE, LEAST_OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Items in a block of the index; items and words of one index, so that it fits the driver and every task; what is beyond
#: them gets further passes. A single item may have more words, as it can't be cut.
BLOCK, ITEMS_PER_INDEX, WORDS_PER_INDEX = 8, 20_000, 1_000_000
#: Sums of block maxima that are held at once for a text.
SUMS = 1 << 20
#: Items up to this many words share passages of twice as many; longer ones get longer passages by powers of two.
SHORT_ITEM = 64

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?]+\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; an item of one sentence is both."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
    return (text.strip()[: ends[-1]], text.strip()[ends[-1] :]) if ends else (text, text)


def runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def overlap(part: set, whole: set) -> float:
    """The share of part that whole holds; an empty part is held by anything."""
    return len(part & whole) / len(part) if part else 1.0


class Index:
    """Postings of one class of items, in blocks with their highest impacts.

    items: (item_id, question, answer, {word: (count, items that have it)}, words of the item).
    """

    def __init__(self, items: list[tuple], total: int, average: float, span: int, least: float = LEAST_SCORE, shingle: int = SHINGLE):
        items = sorted(items, key=lambda i: (i[4], i[0]))
        self.ids, self.span, self.least, self.shingle = [i[0] for i in items], span, least, shingle
        self.questions = [words_of(i[1]) for i in items]
        self.answers = [words_of(i[2]) for i in items]
        made: dict[str, list[tuple[int, float]]] = {}
        for k, (_, _, _, terms, length) in enumerate(items):
            raw = {}
            for w, (count, having) in terms.items():
                idf = np.log(1 + (total - having + 0.5) / (having + 0.5))
                raw[w] = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))
            own = sum(raw.values())
            for w, x in raw.items():
                made.setdefault(w, []).append((k, x / own))
        self.term = {w: t for t, w in enumerate(made)}
        self.items = [[k for k, _ in made[w]] for w in made]
        self.impacts = [[x for _, x in made[w]] for w in made]
        #: For each term its highest impact in each block that has it, and for each block the terms that it has.
        self.block_best: list[dict[int, float]] = []
        self.block_terms: list[set[int]] = [set() for _ in range(-(-len(items) // BLOCK))]
        for t, (ks, xs) in enumerate(zip(self.items, self.impacts, strict=True)):
            best: dict[int, float] = {}
            for k, x in zip(ks, xs, strict=True):
                best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
            self.block_best.append(best)
            for b in best:
                self.block_terms[b].add(t)
        self._flatten()
        # The commonest terms, as long as no item has half the threshold from them together.
        share, rare = np.zeros(len(items)), set(range(len(made)))
        for w in sorted(made, key=lambda w: (-len(made[w]), w)):
            t = self.term[w]
            after = share.copy()
            after[self.items[t]] += self.impacts[t]
            if after.max() > least / 2:
                break
            share = after
            rare.discard(t)
        self.rare = {w: t for w, t in self.term.items() if t in rare}
        self.rest = np.array([share[b * BLOCK : (b + 1) * BLOCK].max() for b in range(len(self.block_terms))])

    def _flatten(self) -> None:
        sizes = [len(b) for b in self.block_best]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.block = np.array([b for best in self.block_best for b in best], np.int64)
        self.best = np.array([x for best in self.block_best for x in best.values()])

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, block): the passages of two spans, and for each the blocks of which an item may reach the threshold."""
        get, span, blocks, n = self.rare.get, self.span, len(self.block_terms), len(self.term)
        hits = [(i, t) for i, w in enumerate(words) if (t := get(w)) is not None]
        if not hits:
            return []
        at, terms = np.array(hits, np.int64).T
        # A term counts once in a cell of one span; a passage is two cells.
        cell, terms = np.divmod(np.unique(at // span * n + terms), n)
        sizes = self.start[terms + 1] - self.start[terms]
        from_ = np.repeat(self.start[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell, block, best = np.repeat(cell, sizes), self.block[from_], self.best[from_]
        out: list[tuple[int, int]] = []
        step = max(1, SUMS // blocks)
        for first in range(0, int(cell[-1]) + 1, step):
            a, b = np.searchsorted(cell, [first, first + step + 1])
            sums = np.bincount((cell[a:b] - first) * blocks + block[a:b], best[a:b], minlength=(step + 1) * blocks if step < cell[-1] + 2 - first else (int(cell[-1]) + 2 - first) * blocks)
            sums = sums.reshape(-1, blocks)
            both = sums[:-1] + sums[1:] + self.rest
            out += [((first + int(k)) * span, int(j)) for k, j in np.argwhere(both >= self.least - 1e-9)]
        return out

    def retrieve(self, terms: set[int], block: int | None = None) -> list[tuple[int, float]]:
        """All items (of one block, or of all) that score at least `least` with these distinct terms: block-max WAND."""
        items, impacts, least = self.items, self.impacts, self.least - 1e-9
        low, high = (0, len(self.ids)) if block is None else (block * BLOCK, (block + 1) * BLOCK)
        if block is not None:
            terms = terms & self.block_terms[block]
        bound_of = {t: max(self.block_best[t].values()) if block is None else self.block_best[t][block] for t in terms}
        cursors = [[items[t][p], t, p] for t in terms if (p := bisect_left(items[t], low)) < len(items[t])]
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += bound_of[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0 or cursors[pivot][0] >= high:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            here = at // BLOCK
            if sum(self.block_best[t].get(here, 0.0) for _, t, _ in cursors[: pivot + 1]) < least:
                beyond = (here + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                cursors = self._advance(cursors, pivot + 1, beyond)
            elif cursors[0][0] == at:
                score = sum(impacts[t][p] for i, t, p in cursors[: pivot + 1] if i == at)
                if score >= least:
                    out.append((at, float(score)))
                cursors = self._advance(cursors, pivot + 1, at + 1)
            else:
                cursors = self._advance(cursors, pivot + 1, at)
        return out

    def _advance(self, cursors: list, upto: int, to: int) -> list:
        out = []
        for k, c in enumerate(cursors):
            if k < upto and c[0] < to:
                p = bisect_left(self.items[c[1]], to, c[2])
                if p == len(self.items[c[1]]):
                    continue
                c = [self.items[c[1]][p], c[1], p]
            out.append(c)
        return out

    def leaks(self, words: list[str]) -> list[tuple]:
        """(item_id, passages, score, question overlap, answer overlap) of the items that retrieval finds in a text."""
        found: dict[int, list] = {}
        start = -1
        for begins, block in self.candidates(words):
            if begins != start:
                start, passage = begins, words[begins : begins + 2 * self.span]
                terms = {t for w in set(passage) if (t := self.term.get(w)) is not None}
            hits = self.retrieve(terms, block)
            if not hits:
                continue
            held: dict[int, set] = {}
            for k, score in hits:
                shares = []
                for part in (self.questions[k], self.answers[k]):
                    n = min(self.shingle, len(part)) or 1
                    if n not in held:
                        held[n] = runs(passage, n)
                    shares.append(overlap(runs(part, n), held[n]))
                old = found.setdefault(k, [0, 0.0, 0.0, 0.0])
                old[0] += 1
                old[1] = max(old[1], score)
                if min(shares) >= min(old[2:]):
                    old[2:] = shares
        return [(self.ids[k], *v) for k, v in found.items()]


def _terms(batches):
    for part in slices(batches):
        out = []
        ids, questions, answers = (part.column(c).to_pylist() for c in ("item_id", "question", "answer"))
        for i, q, a in zip(ids, questions, answers, strict=True):
            words = words_of(q) + (words_of(a) if a != q else [])
            out += [(i, len(words), w, n) for w, n in Counter(words).items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.int64())],
            names=["item_id", "length", "word", "n"],
        )


def _parts(batches):
    for part in slices(batches):
        split = [question_and_answer(t or "") for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string())], names=["item_id", "question", "answer"])


def build_indexes(items: DataFrame, least: float = LEAST_SCORE, shingle: int = SHINGLE, per_index: int = ITEMS_PER_INDEX):
    """How many groups of indexes there are, and a generator of them: one group is built and held at a time.

    A group has about per_index items or WORDS_PER_INDEX words, whichever is less; statistics are those of all items. Items
    without words are in none. items has item_id and question and answer, or text, whose last sentence is then the answer.
    Of rows that repeat an item_id one counts, that of the least question and answer.
    """
    if {"question", "answer"} <= set(items.columns):
        parts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    else:
        parts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_parts, "item_id long, question string, answer string")
    parts = parts.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("question", "answer")).alias("p")).select("item_id", "p.*")
    parts = written(parts)
    terms = written(parts.mapInArrow(_terms, "item_id long, length long, word string, n long"))
    sizes = terms.groupBy("item_id").agg(F.first("length").alias("length"))
    total, words = sizes.agg(F.count("*"), F.sum("length")).first()
    if not total:
        return 0, iter(())
    groups = max(-(-total // per_index), -(-words // WORDS_PER_INDEX))
    slot = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    having = terms.groupBy("word").agg(F.count("*").alias("having"))
    full = written(terms.join(having, "word").withColumn("slot", slot))
    return groups, (_group(full, parts, k, slot, total, words / total, least, shingle) for k in range(groups))


def _group(full: DataFrame, parts: DataFrame, k: int, slot: Column, total: int, average: float, least: float, shingle: int) -> list[Index]:
    held: dict[int, tuple[dict, int]] = {}
    for r in full.where(F.col("slot") == k).select("item_id", "length", "word", "n", "having").collect():
        held.setdefault(r[0], ({}, r[1]))[0][r[2]] = (r[3], r[4])
    texts = {r[0]: (r[1], r[2]) for r in parts.where(slot == k).collect()}
    classes: dict[int, list] = {}
    for i in sorted(held):
        span = SHORT_ITEM
        while span < held[i][1]:
            span *= 2
        classes.setdefault(span, []).append((i, *texts[i], *held[i]))
    return [Index(group, total, average, span, least, shingle) for span, group in sorted(classes.items())]


def _search(shared):
    names = ("doc_id", "item_id", "passages", "score", "question_overlap", "answer_overlap")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches):
        for part in slices(batches):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for index in shared.value:
                    out += [(doc, *leak) for leak in index.leaks(words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return run


def find_leaks(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, shingle: int = SHINGLE, per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """doc_id, item_id, passages, score, question_overlap, answer_overlap of each verified leak of an item into a document.

    A leak is a passage that holds at least least_score of the item's BM25 score, and least_overlap of the runs of
    `shingle` words of its question and of its answer (shorter parts count as one run). Whole texts are searched, in
    passages that overlap by half, so that each item fits into one. Null and empty texts hold nothing; items without words
    are found nowhere. Rows that repeat a document are each searched; other columns are ignored. An empty table on either
    side gives no rows. Items that are alike are each found. More than per_index items, or WORDS_PER_INDEX words, take more
    passes over docs, whose results are written one after the other, so that one index is held at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, passages long, score double, question_overlap double, answer_overlap double"
    held = (F.col("question_overlap") >= least_overlap) & (F.col("answer_overlap") >= least_overlap)
    groups, built = build_indexes(items, least_score, shingle, per_index)
    found = docs.sparkSession.createDataFrame([], schema)
    for indexes in built:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        one = rows.mapInArrow(_search(shared), schema).where(held)
        if groups == 1:
            return one
        found = found.union(written(one))
        shared.destroy()
    return found


def without_leaks(docs: DataFrame, items: DataFrame, least_overlap: float = LEAST_OVERLAP, per_index: int = ITEMS_PER_INDEX) -> DataFrame:
    """docs, with all their columns, without the rows into whose texts find_leaks finds that an item leaked.

    Each row is judged by its own text, so rows without doc_id and rows that repeat one are too; null and empty texts hold
    nothing. An empty table on either side leaves docs as they are.
    """
    groups, built = build_indexes(items, per_index=per_index)
    for indexes in built:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def make(shared=shared):
            held = shared.value

            def passes(text):
                words = words_of(text)
                return not any(min(leak[3:]) >= least_overlap for index in held for leak in index.leaks(words))

            return passes

        docs = filtered(docs, make)
        if groups > 1:
            docs = written(docs)
            shared.destroy()
    return docs
