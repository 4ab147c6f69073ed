"""Personal data: base patterns, then bootstrapped contextual extraction of identifiers that no base pattern knows.

Seeds are the base finds and strings that look like keys (hex digests). Every seed and every other string of identifier
shape is an instance; the words and signs around it are its lexical patterns. Spark scores the graph of patterns and
instances, round by round: a pattern is as good for a kind as the share of known instances of that kind in it, where
instances of other kinds and strings that can't be of that kind count against it and strings that can count for neither; an
unknown instance is as good as its patterns together. Instances that score high become known, patterns are scored anew over
all edges, so that discovered instances raise patterns of their own, and this goes on until nothing new is found. Spans of
discovered instances, and of keys, are added where they stand in a good pattern of their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import free, slices, written

#: Kinds in the order in which spans with one start are listed; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Distinct known instances that a pattern needs, and how good a pattern and an instance must be.
LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE = 4, 0.8, 0.85
#: Counts against every pattern, so that small counts prove less.
PRIOR = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*+")
_DIGIT = re.compile(r"[0-9]+")
#: Groups of digits with signs of numbers between and around them, over single spaces.
_NUMBERS = re.compile(r"[+(]?[0-9][0-9().+/-]*+(?: [(]?[0-9][0-9().+/-]*+)*+")
_ANCHOR = re.compile(r"[0-9@]")
#: What ends an identifier-like string, and what is trimmed from its ends.
_ENDS = frozenset("\"'<>()[]{},;|")
_TRIMMED = ".:/@+-_!?&$%#*=~^`\\"
#: Digits of a number and characters of another string that have identifier shape.
LEAST_DIGITS, LEAST_CHARACTERS = 5, 5
_KEY = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}")
_MAY = (
    ("email", re.compile(r"[^\s@]+@[^\s@]+")),
    ("ip", re.compile(r"[0-9A-Fa-fxX*]*(?:[.:][0-9A-Fa-fxX*]*){2,}(?:/[0-9]+)?")),
    ("card", re.compile(r"[0-9](?:[ .-]?[0-9]){11,18}")),
    ("phone", re.compile(r"[+(]?[0-9](?:[ ().+/-]*[0-9]){6,14}\)?")),
    ("secret", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[!-~]{16,}")),
)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ the longest run of local characters before it and a dotted name after it, left to right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers taken four by four; a four with a part over 255 is dropped."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """From a + and a digit to the last digit of the run; at least one character stands between the two."""
    for m in _PHONE.finditer(text):
        end = m.end()
        while end > m.start() and not ("0" <= text[end - 1] <= "9"):
            end -= 1
        if end - m.start() >= 4 and 9 <= sum("0" <= c <= "9" for c in text[m.start() : end]) <= 15:
            yield m.start(), end


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base finds as (kind, start, end) in code points, by start and then kind as listed; kinds may overlap."""
    found = [(start, k, end) for k, finder in enumerate(FINDERS) if (finder is not emails or "@" in text) for start, end in finder(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def identifiers(text: str) -> Iterator[tuple[int, int]]:
    """Strings of identifier shape, left to right: runs of number groups of LEAST_DIGITS digits, and strings without white
    space, quotes and brackets, of LEAST_CHARACTERS, that have a digit or an @; of any length, without signs at their ends."""
    done, m = 0, _ANCHOR.search(text)
    while m:
        at = m.start()
        start = at
        while start > done and not text[start - 1].isspace() and text[start - 1] not in _ENDS:
            start -= 1
        end, size = at + 1, len(text)
        while end < size and not text[end].isspace() and text[end] not in _ENDS:
            end += 1
        if (n := _NUMBERS.match(text, start - (start > done and text[start - 1] == "("))) and n.end() >= end:
            start, end = n.start(), n.end()
            while not "0" <= text[end - 1] <= "9":
                end -= 1
            if sum("0" <= c <= "9" for c in text[start:end]) >= LEAST_DIGITS:
                yield start, end
            done = n.end()
        else:
            done = end
            while end > start and text[end - 1] in _TRIMMED:
                end -= 1
            while start < end and text[start] in _TRIMMED:
                start += 1
            if end - start >= LEAST_CHARACTERS:
                yield start, end
        m = _ANCHOR.search(text, done)


def may_be(found: str) -> list[str]:
    """The kinds whose shape a string has."""
    return [kind for kind, shape in _MAY if shape.fullmatch(found)]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _before(text: str, at: int, n: int) -> list[str]:
    """The last n words or single signs before a place, whole; `^` stands before the beginning."""
    out = []
    while len(out) < n:
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            return ["^"] * (n - len(out)) + out
        end = at
        at -= 1
        if _word(text[at]):
            while at and _word(text[at - 1]):
                at -= 1
        out.insert(0, _DIGIT.sub("0", text[at:end].lower()))
    return out


def _behind(text: str, at: int, n: int) -> list[str]:
    """The first n words or single signs behind a place, whole; `$` stands behind the end."""
    out, size = [], len(text)
    while len(out) < n:
        while at < size and text[at].isspace():
            at += 1
        if at == size:
            return out + ["$"] * (n - len(out))
        start = at
        at += 1
        if _word(text[start]):
            while at < size and _word(text[at]):
                at += 1
        out.append(_DIGIT.sub("0", text[start:at].lower()))
    return out


def _hash(said: str) -> int:
    return int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Three words or signs before; two before and one behind; one before and two behind. Digits count as 0.

    A pattern has a word with a letter.
    """
    b, a = _before(text, start, 3), _behind(text, end, 2)
    made = ([*b, "_"], [*b[1:], "_", a[0]], [b[2], "_", *a])
    return [" ".join(p) for p in made if any(c.isalpha() for w in p for c in w)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64())), ("may", pa.list_(pa.string()))])
_FOUND = (
    "rid long, doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "mentions array<struct<kind: string, start: long, end: long, instance: long, patterns: array<long>, may: array<string>>>"
)


def _find(batches):
    for part in slices(batches):
        columns: list[list] = [[] for _ in range(7)]
        for text in part.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            for k, kind in enumerate(KINDS[:4]):
                columns[k].append(sum(s[0] == kind for s in spans))
            said = listed(spans)
            columns[4].append(hashlib.sha256(said.encode()).hexdigest())
            columns[5].append(said)
            columns[6].append([_mention(text, *m) for m in _mentions(text, spans)])
        yield pa.RecordBatch.from_arrays(
            [part.column("rid"), part.column("doc_id"), part.column("text_hash"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]), pa.array(columns[6], pa.list_(_MENTION))],
            names=["rid", "doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "mentions"],
        )


def _mentions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, int, int]]:
    """Base finds, keys, and what else has identifier shape and overlaps no base find."""
    yield from spans
    k, reached = 0, 0
    for s, e in identifiers(text):
        while k < len(spans) and spans[k][1] < e:
            reached, k = max(reached, spans[k][2]), k + 1
        if s >= reached:
            yield ("secret" if _KEY.fullmatch(text, s, e) else None), s, e


def _mention(text: str, kind: str | None, start: int, end: int) -> dict:
    said = text[start:end]
    return {"kind": kind, "start": start, "end": end, "instance": _hash(said.lower()), "patterns": [_hash(p) for p in patterns(text, start, end)], "may": [] if kind else may_be(said)}


def discover(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From mentions (kind or null, instance, patterns, may): good patterns (pattern, kind), known instances (instance, kind).

    All scores are sums over the distinct edges of the pattern-instance graph, so frequent mentions count once.
    """
    edges = mentions.select("kind", "instance", "may", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance")
    edges = written(edges.agg(F.max("kind").alias("kind"), F.first("may").alias("may")))
    # Only patterns that can come to enough known instances, and that hold something to add, can matter.
    open_ = F.count_if(F.col("kind").isNull() | (F.col("kind") == "secret"))
    useful = edges.groupBy("pattern").agg(F.count("*").alias("size"), open_.alias("open")).where((F.col("size") >= LEAST_SEEDS) & (F.col("open") > 0))
    edges = written(edges.join(useful.select("pattern"), "pattern"))
    unknown = edges.where("kind is null").select("pattern", "instance", "may")
    strangers = unknown.groupBy("pattern").agg(F.count("*").alias("strangers"))
    able = unknown.select("pattern", F.explode("may").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("able"))
    against = written(strangers.join(able, "pattern", "left"))
    known = written(edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    good = None
    while True:
        held = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n"))
        all_ = held.groupBy("pattern").agg(F.sum("sum").alias("all"))
        scored = held.where(F.col("n") >= LEAST_SEEDS).join(all_, "pattern").join(strangers, "pattern", "left").join(against.select("pattern", "kind", "able"), ["pattern", "kind"], "left")
        unable = F.coalesce("strangers", F.lit(0)) - F.coalesce("able", F.lit(0))
        worth = F.col("sum") / (F.col("all") + unable + PRIOR)
        now = scored.select("pattern", "kind", worth.alias("worth")).where(F.col("worth") >= LEAST_PATTERN)
        # What was good stays good, so that the rounds come to an end.
        good = written(now if good is None else now.unionByName(good).groupBy("pattern", "kind").agg(F.max("worth").alias("worth")))
        reached = unknown.join(good, "pattern").where(F.array_contains("may", F.col("kind"))).groupBy("instance", "kind")
        reached = reached.agg((1 - F.exp(F.sum(F.log1p(-F.least("worth", F.lit(0.999)))))).alias("score"))
        best = reached.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        new = written(best.where(F.col("score") >= LEAST_INSTANCE).join(known.select("instance"), "instance", "left_anti"))
        if not new.limit(1).count():
            return good.select("pattern", "kind"), known.select("instance", "kind")
        known = written(known.unionByName(new))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every row's whole text.

    The counts and base_sha256 are of the base finds; spans also lists the n_found spans that the bootstrapping adds, of the
    base kinds and of secrets. Texts, contexts and finds may have any length. Null texts are empty; texts without finds have
    the empty list. Of kinds that score alike for an instance the last in the alphabet is taken. Repeated rows have equal
    results; rows with equal doc_id are each read for themselves; other columns are ignored. An empty table gives no rows.
    """
    found, added = _with_added(docs)
    all_rows = found.drop("mentions").join(added, "rid", "left")
    base = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end")))
    merged = F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind: string, start: long, end: long>>")))
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(merged, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    said = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n_found = F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("long")
    return all_rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", said.alias("spans"), n_found.alias("n_found"))


def _with_added(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What _find says of every row, and (rid, added) of the rows to which the bootstrapping adds spans."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(rows.mapInArrow(_find, _FOUND))
    mentions = found.select("rid", F.inline("mentions")).where(F.size("patterns") > 0)
    good, known = discover(mentions)
    candidates = mentions.where("kind is null or kind = 'secret'").select("rid", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    added = candidates.join(known, "instance").join(good, ["pattern", "kind"]).select("rid", "kind", "start", "end").distinct()
    return found, written(added.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first rules."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all rows and columns, with personal data masked in text and n_chars (where there is one) counted anew.

    Spans are those of find_personal_data. Those that the bootstrapping adds come back to their rows by doc_id and the hash
    of the text, so equal rows share them. Null texts stay null and their n_chars as it was.
    """
    found, added = _with_added(docs.select("doc_id", "text"))
    id_, hash_, more = (free(docs.columns, c) for c in ("id", "text_hash", "added"))
    held = found.select("rid", "doc_id", "text_hash").join(added, "rid").groupBy("doc_id", "text_hash").agg(F.first("added").alias(more))
    held = written(held.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), more))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    joined, names = docs.join(held, same, "left").select(*docs.columns, more), docs.columns

    def mask(batches):
        for part in slices(batches):
            texts, extra = part.column("text").to_pylist(), part.column(more).to_pylist()
            new = [t if t is None else masked(t, base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in x or []]) for t, x in zip(texts, extra, strict=True)]
            columns = []
            for name in names:
                column = part.column(name)
                if name == "text":
                    column = pa.array(new, column.type)
                elif name == "n_chars":
                    column = pa.array([n if t is None else len(t) for t, n in zip(new, column.to_pylist(), strict=True)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(mask, docs.schema)
