"""Token counts: greedy longest-match word pieces, counted by a linear automaton that builds no piece.

The vocabulary's trie gets, for every node, a failure link and the number of pieces that are popped on the way there: if no
edge leads on from a node, its longest piece is taken off (or several) and matching goes on from the node of what remains.
Every symbol of the vocabulary counts as a piece, so that something can always be taken off: a symbol that is none of its
own counts as one unknown piece, which is the same. So every symbol of a word is read once, whatever the vocabulary.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import slices

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Distinct words whose counts a task remembers at most, and the longest word that it remembers.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [rest.get(b, chr(b)) for b in range(256)]


def read_pieces(path: str = VOCABULARY, end: str = "</w>") -> list[str]:
    """The pieces of a tokenizer file whose words end in `end`, with that end as one symbol (a space)."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    return [p.removesuffix(end) + " " * p.endswith(end) for p in held["model"]["vocab"] if p not in special]


class LongestMatch:
    """Counts the pieces of a word; a symbol that begins no piece counts as one unknown piece."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in [*sorted({symbol for piece in pieces for symbol in piece}), *pieces]:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][symbol]
            ends[node] = node > 0
        #: Where matching goes on after the longest piece is popped, and how many pieces that pops.
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for symbol, node in self.next[at].items():
                queue.append(node)
                if ends[node]:
                    self.popped[node] = 1
                    continue
                back, count = self.fail[at], self.popped[at]
                while symbol not in self.next[back]:
                    back, count = self.fail[back], count + self.popped[back]
                self.fail[node], self.popped[node] = self.next[back][symbol], count

    def count(self, word: str) -> int:
        """How many pieces greedy longest match gives."""
        nexts, fail, popped = self.next, self.fail, self.popped
        node, total = 0, 0
        for symbol in word:
            while (on := nexts[node].get(symbol)) is None and node:
                total += popped[node]
                node = fail[node]
            if on is None:
                total += 1  # a symbol of no piece
            else:
                node = on
        while node:
            total += popped[node]
            node = fail[node]
        return total


_READY: list[tuple[list[str], LongestMatch]] = []


def _automaton(pieces: list[str]) -> LongestMatch:
    """The automaton of these pieces; a Python worker builds it once for all its tasks."""
    for held, ready in _READY:
        if held is pieces:
            return ready
    _READY[:] = [(pieces, LongestMatch(pieces))]
    return _READY[0][1]


def _count(shared, lower: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        automaton = _automaton(shared.value)
        symbols = byte_symbols()
        spell = {i: s for i, s in enumerate(symbols)}
        known: dict[str, int] = {}
        for part in slices(batches):
            words_of, tokens_of = [], []
            for text in part.column("text").to_pylist():
                words = ((text or "").lower() if lower else text or "").split()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(spell) + " ")
                        if len(known) < REMEMBERED and len(word) <= REMEMBERED_LENGTH:
                            known[word] = n
                    total += n
                words_of.append(len(words))
                tokens_of.append(total)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, vocabulary: str | list[str] = VOCABULARY, lower: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text: its words (by white space) cut by greedy longest match.

    vocabulary is a tokenizer file, read once by the driver, or a list of pieces over byte symbols in which a space ends a
    word. Each Python worker holds its automaton, about 300 bytes a node, so the workers' memory bounds it. Null and blank texts have no tokens; a symbol that begins no piece is one
    token. Words of any length are read
    once. Repeated rows are counted alike; other columns are ignored. An empty table gives no rows.
    """
    pieces = read_pieces(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_count(shared, lower), "doc_id long, n_words long, n_tokens long")
