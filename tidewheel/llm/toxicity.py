"""Toxicity by lexicon induction: random walks over a word graph carry the polarity of labelled seed terms to other words.

1. Seeds: in each language, words that stand in toxic documents far more often than in others, and the clean ones likewise,
   from a sample of at most SAMPLE labelled documents, near copies in it counted once. A toxic seed needs smoothed log-odds
   of LEAST_ODDS, which doesn't depend on the number of labels, and an exact test of its counts at the false discovery
   rate FDR, which asks for as much support as that number can give. Languages without a seed are tested together.
2. Counts over the distinct lines of all documents: in how many lines of a language each word stands, and in how many
   together with a word of the frontier. Lines of the same set of words are one line in all counts, so that a passage
   counts once however many documents repeat it.
3. Graph: an edge weighs the positive pointwise mutual information of two words in the lines of a language, less
   log(SHIFT), where the shared count is replaced by its lower confidence bound, so that chance neighbours of rare
   words make no edge. The frontier is first the seeds, then the words whose rate of visits from toxic
   seeds reaches PUSH: HOPS rounds.
4. Walks with restart from the toxic and from the clean seeds give each word two visiting rates; their
   difference over their sum and PRIOR seeds' rate is its polarity. A positive one needs support: edges to positive words
   whose polarities add up to SUPPORT, or to the number of seeds where they are fewer; a seed counts 1. Words that
   got support give it in turn, so that a word can be reached over several hops. Of several languages' polarities a word keeps the highest.
5. A document's score is the sum of its words' polarities from LEAST_WEIGHT on over their number; the threshold is
   the one with the best F1 on the sample.

The graph stays distributed. Each edge has an end in the frontiers (those of all rounds), so that a walk that leaves them is back after one
step: the words beyond are eliminated by a join of their edges with each other, whose sums are a matrix over the frontiers' words. The driver
walks on this matrix, with the same steps as over the whole graph, and a join of the edges with the frontiers' rates gives those of all other words.

Cost: HOPS + 3 scans. The first shuffles a key of 8 bytes for each line and makes a filter of fixed size of those that stand more than once; it is broadcast.
Lines that it rules out are counted where they are, and only the others, one copy from each task at most for each set of counts, are shuffled with their
words. With more repeated lines than the filter tells apart more lines take this way, and the counts are the same. What else moves is counts that each
task has summed. A frontier has at most 1 / PUSH words a language, since the rates add up to 1, and the
driver holds the matrix of the frontiers and the lexicon. As the rates from toxic seeds add up to 1 and a seed's own is at least
RESTART / SEEDS, at most SEEDS / (PRIOR * RESTART * LEAST_WEIGHT) words of a language can reach LEAST_WEIGHT.

Defined cases: words are runs of letters, in lower case; null and blank texts score 0 and aren't toxic; very long texts count whole; without labelled
documents of both kinds, or without seeds, no document is toxic; a null id is kept, and teaches nothing; rows that repeat an id each
have their own score, and where such an id is labelled, its least language and text teach; an empty table gives an empty result; other columns
pass through ``clean`` unchanged, whatever their names, and through ``scores``, but for score and toxic, which are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import near_dup
from tidewheel.llm.common import on_texts, pieces, table, written

SAMPLE = 5000
SEEDS, CLEAN_SEEDS = 40, 40
#: Least smoothed log-odds of a toxic seed, and the rate of false ones among them; clean seeds need CLEAN_DOCS documents, or CLEAN_SHARE of few.
LEAST_ODDS, FDR = math.log(10), 0.05
CLEAN_DOCS, CLEAN_SHARE = 20, 0.02
#: Words in a larger share of the labelled documents are no seeds; in a larger share of the lines, no neighbours.
SEED_SHARE, STOP_SHARE = 0.25, 0.05
SHIFT = 3.0
#: Normal quantile of the lower bound of a count.
BOUND_Z = 2.5
HOPS = 2
PUSH = 0.004
RESTART = 0.3
PRIOR = 0.25
#: Toxic seeds, or as many positive words as have their weight, that a word must have edges with to get a positive polarity or into the frontier.
SUPPORT = 3
#: Least polarity of a word in the lexicon.
LEAST_WEIGHT = 0.02
#: Steps of a walk; what is left out of the rates is less than (1 - RESTART) ** STEPS.
STEPS = 60
#: Words that a task counts before it hands its counts on.
HELD = 100_000
#: Words of 64 bits in the filter that tells which lines may be repeated; a power of two.
FILTER_WORDS = 1 << 20

WORD = re.compile(r"[^\W\d_]+")


def line_words(text: str | None) -> Iterator[set[str]]:
    for line in (text or "").lower().split("\n"):
        found = set(WORD.findall(line))
        if found:
            yield found


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # polarity, to 1
    threshold: float

    def score(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        get = self.weights.get
        return sum(get(w, 0.0) for w in words) / len(words) if words else 0.0


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str | None, bool]]:
    """(language, text, toxic) of the sample."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = light(docs, "doc_id").join(F.broadcast(chosen), "doc_id")  # the sample bounds it
    rows = found.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"), F.max("toxic").alias("toxic")).orderBy("doc_id")
    return [(r.x.lang, r.x.text, r.toxic > 0) for r in rows.collect()]


def light(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))


def without_copies(rows: list[tuple[str, str | None, bool]]) -> list[tuple[str, str | None, bool]]:
    """The rows, of near copies with one label only the first."""
    at, sig = np.zeros(0, int), np.zeros((0, near_dup.COORDS), np.int32)
    for lo in range(0, len(rows), 256):
        some, values = near_dup.signatures(pa.array([r[1] or "" for r in rows[lo : lo + 256]], pa.string()))
        at, sig = np.concatenate([at, some + lo]), np.concatenate([sig, values])
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for c in range(sig.shape[1]):
        first: dict[int, int] = {}
        for k, v in enumerate(sig[:, c].tolist()):
            j = first.setdefault(v, k)
            if j != k and root(int(at[j])) != root(int(at[k])) and (sig[j] == sig[k]).sum() >= near_dup.MATCHES:
                a, b = sorted((root(int(at[j])), root(int(at[k]))))
                parent[b] = a
    kept: dict[tuple[int, bool], tuple[str, str | None, bool]] = {}
    for i, r in enumerate(rows):
        kept.setdefault((root(i), r[2]), r)
    return list(kept.values())


def hypergeometric(toxic: int, total: int, held: int) -> np.ndarray:
    """Probabilities of 0, 1, .. held: how many of the documents that hold a word are toxic, if it says nothing of toxicity."""
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    ways = log(total, held)
    return np.array([math.exp(log(toxic, k) + log(total - toxic, held - k) - ways) if k <= toxic and held - k <= total - toxic else 0.0 for k in range(held + 1)])


def seeds(rows: list[tuple[str, str | None, bool]]) -> tuple[list[str], list[str]]:
    """Toxic and clean seed terms of (language, text, toxic).

    The tests are exact in each language, and a word's counts add up over languages. Of the words, those take part
    that could be found at all in as many tests (Tarone's and Gilbert's step for discrete tests)."""
    strata: dict[str, tuple[list[int], Counter[str], Counter[str]]] = {}
    for lang, text, toxic in rows:
        n, clean, bad = strata.setdefault(lang, ([0, 0], Counter(), Counter()))
        n[toxic] += 1
        (bad if toxic else clean).update(set(WORD.findall((text or "").lower())))
    n = [sum(s[0][c] for s in strata.values()) for c in (0, 1)]
    if not all(n):
        return [], []
    total = sum(n)
    seen = [Counter[str](), Counter[str]()]
    for s in strata.values():
        seen[0].update(s[1])
        seen[1].update(s[2])
    sizes = [s[0] for s in strata.values()]

    @lru_cache(None)
    def chances(held: tuple[int, ...]) -> tuple[np.ndarray, float]:
        """Tail probabilities by the number of toxic documents, and the least that is possible."""
        p = np.ones(1)
        for size, k in zip(sizes, held, strict=True):
            p = np.convolve(p, hypergeometric(size[1], sum(size), k))
        tail = np.cumsum(p[::-1])[::-1]
        return tail, float(tail[np.flatnonzero(p)[-1]])

    def odds(w: str) -> float:
        held = [[s[c + 1][w] for c in (0, 1)] for s in strata.values()]
        a, b, c, d = (sum(x) for x in zip(*((h[1] + 0.5, z[1] - h[1] + 0.5, h[0] + 0.5, z[0] - h[0] + 0.5) for h, z in zip(held, sizes, strict=True)), strict=True))
        return math.log(a / b) - math.log(c / d)

    tests: list[tuple[float, float, str]] = []  # least and actual probability
    for w in seen[0].keys() | seen[1].keys():
        k = seen[0][w] + seen[1][w]
        if 2 <= k <= max(SEED_SHARE * total, 2):
            tail, lowest = chances(tuple(s[1][w] + s[2][w] for s in strata.values()))
            if lowest <= FDR:
                tests.append((lowest, float(tail[seen[1][w]]), w))
    tests.sort()
    least = [t[0] for t in tests]
    m = next((j for j in range(1, len(tests) + 1) if bisect_right(least, FDR / j) <= j), 0)
    ranked = sorted((p, w) for _, p, w in tests[: bisect_right(least, FDR / m) if m else 0])
    last = max((i for i, (p, _) in enumerate(ranked, 1) if p <= FDR * i / len(ranked)), default=0)
    bad = [w for _, w in ranked[:last] if odds(w) >= LEAST_ODDS]

    def z(w: str) -> float:
        p = (seen[0][w] + seen[1][w]) / total
        return (seen[1][w] / n[1] - seen[0][w] / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1])) if p < 1 else 0.0

    enough = max(2, min(CLEAN_DOCS, CLEAN_SHARE * total))
    good = sorted(((z(w), w) for w, k in seen[0].items() if enough <= k <= CLEAN_SHARE * total + CLEAN_DOCS), key=lambda x: (x[0], x[1]))
    return bad[:SEEDS], [w for v, w in good[:CLEAN_SEEDS] if v < 0]


def seeds_by_language(rows: list[tuple[str, str | None, bool]]) -> dict[str, tuple[list[str], list[str]]]:
    """The seeds of each language that has any; languages without seeds of their own are pooled."""
    starts = {x: seeds([r for r in rows if r[0] == x]) for x in sorted({r[0] for r in rows})}
    few = {x for x, (bad, _) in starts.items() if not bad}
    if len(few) > 1:
        pool = seeds([r for r in rows if r[0] in few])
        starts |= dict.fromkeys(sorted(few), pool)
    return {x: s for x, s in starts.items() if s[0]}


def line_key(lang: str, found: set[str]) -> int:
    """64 bits that stand for the line's set of words."""
    return int.from_bytes(blake2b(f"{lang} {' '.join(sorted(found))}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Repeated:
    """Tells of lines whether they may stand more than once among all: a filter of FILTER_WORDS words of 64 bits, each key setting three bits of one word.

    Of repeated lines it never says no; others it may take for repeated, which costs a shuffle of them and changes no count."""

    def __init__(self, bits) -> None:  # noqa: ANN001
        self.bits = bits  # a broadcast variable
        self._view = None

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "_view": None}

    def __contains__(self, key: int) -> bool:
        if self._view is None:
            self._view = memoryview(self.bits.value).cast("Q")
        mask = 1 << (key >> 32 & 63) | 1 << (key >> 38 & 63) | 1 << (key >> 44 & 63)
        return self._view[key & len(self._view) - 1] & mask == mask


def repeated_lines(docs: DataFrame) -> Repeated:
    """The filter of the lines' keys that stand more than once; only keys are shuffled."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [line_key(lang, words) for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) for words in line_words(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])

    several = written(light(docs).mapInArrow(keys, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "toxic-repeated")
    bit = lambda by: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {by}) & 63 as int))")
    mask = bit(32).bitwiseOR(bit(38)).bitwiseOR(bit(44))
    # as many rows as the filter has words, at most
    words = several.select(F.expr(f"h & {FILTER_WORDS - 1}").alias("i"), mask.alias("m")).groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[words.column("i").to_numpy()] = words.column("m").to_numpy()
    return Repeated(docs.sparkSession.sparkContext.broadcast(bits.tobytes()))


def line_counts(docs: DataFrame, repeated: Repeated) -> DataFrame:
    """(lang, word, n): distinct lines of the language that hold the word; "" has the number of lines. Words of one line are left out, since they make no edge.

    A line that may be repeated is a word of its own, after a line feed, until the first sums have made one of all its copies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])

        for b in pieces(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for found in line_words(text):
                    if line_key(lang, found) in repeated:
                        held[lang, "\n" + " ".join(sorted(found))] = 1
                    else:
                        held.update((lang, w) for w in found)
                        held[lang, ""] += 1
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    first = written(light(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "toxic-lines")
    line = F.col("word").startswith("\n")
    copies = first.filter(line).select("lang", F.explode(F.concat(F.array(F.lit("")), F.split(F.substring("word", 2, 2**31 - 1), " "))).alias("word"), F.lit(1).cast("long").alias("n"))
    return written(first.filter(~line).unionByName(copies).groupBy("lang", "word").agg(F.sum("n").alias("n")).filter("n > 1 or word = ''"), "toxic-lines")


def neighbours(docs: DataFrame, frontier: dict[str, set[str]], stop: dict[str, set[str]], counts: DataFrame, repeated: Repeated) -> DataFrame:
    """(lang, a, b, weight) for each a of the language's frontier: the edges of the graph that it has.

    Pairs are counted in the tasks. A line that may be repeated goes on as a pair of its own, of -1 and its key, language and words, until the first sums
    have made one of all its copies; then its pairs are counted."""
    spark = docs.sparkSession
    starts = [(x, a) for x in sorted(frontier) for a in sorted(frontier[x])]
    place = {key: i for i, key in enumerate(starts)}

    def counted(lines: Iterator[tuple[str, set[str], int | None]]) -> Iterator[pa.RecordBatch]:
        """at, b, both of lines (language, words, key); those with a key are given on."""
        held: dict[int, Counter[str]] = defaultdict(Counter)
        size = 0

        def out() -> pa.RecordBatch:
            at = [i for i, c in held.items() for _ in c]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([w for c in held.values() for w in c], pa.string()), pa.array([n for c in held.values() for n in c.values()], pa.int32())], ["at", "b", "both"])

        for lang, words, key in lines:
            if key is not None:
                size += 1
                held[-1][f"{key} {lang}\n{' '.join(sorted(words))}"] = 1
            else:
                for a in frontier[lang].intersection(words):
                    c = held[place[lang, a]]
                    size -= len(c)
                    c.update(words)
                    size += len(c)
            if size > HELD:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[str, set[str], int | None]]:
            for b in pieces(batches):
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    wanted = frontier.get(lang)
                    for found in line_words(text) if wanted else ():
                        if not wanted.isdisjoint(found):
                            key = line_key(lang, found)
                            yield lang, found - stop.get(lang, set()), key if key in repeated else None

        yield from counted(lines())

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[str, set[str], int | None]]:
            for b in pieces(batches):
                for text in b.column("b").to_pylist():
                    head, _, words = text.partition("\n")
                    yield head.partition(" ")[2], set(words.split(" ")) if words else set(), None

        yield from counted(lines())

    kind = "at int, b string, both int"
    sums = lambda df: df.groupBy("at", "b").agg(F.sum("both").cast("int").alias("both"))
    first = written(sums(light(docs).mapInArrow(of_texts, kind)), "toxic-pairs")
    copies = first.filter("at = -1").select("b").mapInArrow(of_lines, kind)
    both = sums(first.filter("at >= 0").unionByName(copies))
    names = spark.createDataFrame([(i, *key) for i, key in enumerate(starts)], "at int, lang string, a string")
    bound = F.col("both") - BOUND_Z * F.sqrt(F.col("both").cast("double"))
    both = both.filter(bound > 0).join(F.broadcast(names), "at").filter("a != b")  # names: the frontier's words
    ends = lambda x: counts.filter("word != ''").select("lang", F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    total = counts.filter("word = ''").select("lang", F.col("n").alias("n_lines"))
    return (
        both.join(ends("b"), ["lang", "b"]).join(ends("a"), ["lang", "a"]).join(total, "lang")
        .withColumn("weight", F.log(bound * F.col("n_lines") / (F.col("n_a").cast("double") * F.col("n_b")) / SHIFT))
        .filter("weight > 0")
        .select("lang", "a", "b", "weight")
    )


@dataclass
class Side:
    """A language's part of the walk on the driver: the frontiers' words and the sums over all others."""

    names: list[str]
    bad: list[str]
    good: list[str]

    def __post_init__(self) -> None:
        n = len(self.names)
        self.at = {w: i for i, w in enumerate(self.names)}
        self.direct, self.through, self.degree = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
        self.starts = np.zeros(n, bool)
        self.starts[[self.at[w] for w in self.bad]] = True

    def visits(self, start: list[str], restart: float = RESTART) -> tuple[np.ndarray, np.ndarray]:
        """The rates of the frontiers' words, and what each of their edges' weight gives to the rate of a word beyond."""
        s = np.zeros(len(self.names))
        if not start:
            return s, s
        np.add.at(s, [self.at[w] for w in start], 1 / len(start))
        degree = self.degree + self.direct.sum(axis=1)
        given = lambda p: p / np.where(degree > 0, degree, 1)
        before, p = np.zeros_like(s), s.copy()
        for _ in range(STEPS):
            step = given(p) @ self.direct + (1 - restart) * (given(before) @ self.through)
            before, p = p, restart * s + (1 - restart) * (step + s * p[degree == 0].sum())
        return p, (1 - restart) * given(before)

    def walk(self) -> None:
        self.plus, self.gives_plus = self.visits(self.bad)
        self.minus, self.gives_minus = self.visits(self.good)
        self.prior = float(PRIOR * self.plus[self.starts].mean())
        self.polarity = (self.plus - self.minus) / (self.plus + self.minus + self.prior)
        self.needed = min(SUPPORT, int(self.starts.sum()))
        self.found = self.starts.copy()

    def strength(self) -> np.ndarray:
        return np.where(self.starts, 1.0, np.where(self.found, np.maximum(self.polarity, 0), 0))

    def grown(self, beyond: np.ndarray) -> bool:
        """Whether words of the frontiers join, given the support that they have from words beyond."""
        size = self.found.sum()
        while True:
            support = (self.direct > 0) @ self.strength() + beyond
            found = self.found | ((support >= self.needed) & (self.polarity > 0))
            if found.sum() == self.found.sum():
                return bool(found.sum() > size)
            self.found = found


def walked(edges: DataFrame, starts: Mapping[str, tuple[list[str], list[str]]], frontiers: Mapping[str, set[str]], least: float = LEAST_WEIGHT) -> tuple[dict[str, dict[str, float]], dict[str, set[str]]]:
    """By language: the words with support and a polarity of at least ``least``, and those among all others whose rate of visits from toxic seeds reaches PUSH.

    edges: (lang, a, b, weight) with each a in the frontiers, as neighbours() gives them, written."""
    spark = edges.sparkSession
    sides = {x: Side(sorted(frontiers[x]), bad, good) for x, (bad, good) in starts.items()}
    rows = lambda f, kind: F.broadcast(spark.createDataFrame([(x, w, *v) for x, side in sides.items() for w, v in zip(side.names, f(side), strict=True)], f"lang string, {kind}"))
    inside = rows(lambda side: [()] * len(side.names), "b string")  # as many rows as the frontiers have words
    for r in edges.join(inside, ["lang", "b"]).select("lang", "a", "b", "weight").collect():
        side = sides[r.lang]
        i, j = side.at[r.a], side.at[r.b]
        side.direct[i, j] = side.direct[j, i] = r.weight
    out = written(edges.join(inside, ["lang", "b"], "left_anti").select("lang", "a", "b", "weight"), "toxic-beyond")
    for r in out.groupBy("lang", "a").agg(F.sum("weight").alias("w")).collect():
        sides[r.lang].degree[sides[r.lang].at[r.a]] = r.w
    degree = out.groupBy("lang", "b").agg(F.sum("weight").alias("degree"))
    left, right = out.join(degree, ["lang", "b"]).select("lang", "b", "a", (F.col("weight") / F.col("degree")).alias("share")), out.select("lang", "b", F.col("a").alias("to"), "weight")
    for r in left.join(right, ["lang", "b"]).groupBy("lang", "a", "to").agg(F.sum(F.col("share") * F.col("weight")).alias("w")).collect():
        side = sides[r.lang]
        side.through[side.at[r.a], side.at[r.to]] = r.w
    for side in sides.values():
        side.walk()
    gives = rows(lambda side: zip(side.gives_plus.tolist(), side.gives_minus.tolist(), [side.prior] * len(side.names), strict=True), "a string, _plus double, _minus double, prior double")
    rates = out.join(gives, ["lang", "a"]).groupBy("lang", "b").agg(F.sum(F.col("weight") * F.col("_plus")).alias("plus"), F.sum(F.col("weight") * F.col("_minus")).alias("minus"), F.max("prior").alias("prior"))
    positive = rates.filter("plus > minus").select("lang", "b", "plus", ((F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus") + F.col("prior"))).alias("polarity"))
    near = written(out.select("lang", "a", "b").join(positive, ["lang", "b"]), "toxic-near")
    while True:
        strength = rows(lambda side: [(v, side.needed) for v in side.strength().tolist()], "a string, strength double, needed int")
        held = near.join(strength, ["lang", "a"]).groupBy("lang", "b", "plus", "polarity").agg(F.sum("strength").alias("support"), F.max("needed").alias("needed"))
        held = written(held.filter("support >= needed").select("lang", "b", "plus", "polarity"), "toxic-held")
        beyond = {x: np.zeros(len(side.names)) for x, side in sides.items()}
        for r in near.select("lang", "a", "b").join(held, ["lang", "b"]).groupBy("lang", "a").agg(F.sum("polarity").alias("p")).collect():
            beyond[r.lang][sides[r.lang].at[r.a]] = r.p
        if not any([side.grown(beyond[x]) for x, side in sides.items()]):
            break
    lexicon = {x: {w: float(side.polarity[i]) for w, i in side.at.items() if side.found[i] and side.polarity[i] >= least} for x, side in sides.items()}
    following: dict[str, set[str]] = {x: set() for x in sides}
    for r in held.filter((F.col("polarity") >= least) | (F.col("plus") >= PUSH)).collect():
        if r.polarity >= least:
            lexicon[r.lang][r.b] = r.polarity
        if r.plus >= PUSH:
            following[r.lang].add(r.b)
    return lexicon, following


def threshold(scores: list[tuple[float, bool]]) -> float:
    """The midpoint between scores with the best F1; infinite if no score is above 0."""
    positive = sum(t for _, t in scores)
    ordered = sorted(scores, key=lambda x: -x[0])
    best, cut, hit = 0.0, math.inf, 0
    for i, (s, t) in enumerate(ordered):
        hit += t
        following = ordered[i + 1][0] if i + 1 < len(ordered) else 0.0
        if s <= 0:
            break
        if following < s and (f1 := 2 * hit / (i + 1 + positive)) > best:
            best, cut = f1, (s + following) / 2
    return cut


def induce(docs: DataFrame, labels: DataFrame, hops: int = HOPS) -> Lexicon:
    rows = without_copies(labelled(docs, labels))
    starts = seeds_by_language(rows)
    if not starts:
        return Lexicon({}, math.inf)
    repeated = repeated_lines(docs)
    counts = line_counts(docs, repeated)
    n_lines = counts.filter("word = ''").select("lang", F.col("n").alias("n_lines"))
    stop: dict[str, set[str]] = {}
    for r in counts.filter("word != ''").join(F.broadcast(n_lines), "lang").filter(F.col("n") > STOP_SHARE * F.col("n_lines")).collect():
        stop.setdefault(r.lang, set()).add(r.word)
    frontier = {x: {*bad, *good} for x, (bad, good) in starts.items()}
    done: dict[str, set[str]] = {x: set() for x in starts}
    edges: DataFrame | None = None
    weights: dict[str, dict[str, float]] = {}
    for _ in range(hops):
        new = written(neighbours(docs, frontier, stop, counts, repeated), "toxic-edges")
        edges = new if edges is None else edges.unionByName(new)
        done = {x: done[x] | frontier[x] for x in starts}
        weights, frontier = walked(edges, starts, done)
        if not any(frontier.values()):
            break
    merged: dict[str, float] = {}
    for polarity in weights.values():
        for w, value in polarity.items():
            merged[w] = max(round(value, 6), merged.get(w, 0.0))
    scorer = Lexicon(merged, 0.0)
    return Lexicon(merged, threshold([(scorer.score(t), toxic) for _, t, toxic in rows]))


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with score and toxic, which take the place of columns of these names."""
    scored = on_texts("double", lambda texts: [round(lexicon.score(t), 6) for t in texts])
    return docs.withColumn("score", scored(F.col("text").cast("string"))).withColumn("toxic", F.col("score") >= F.lit(lexicon.threshold))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that aren't toxic."""
    lexicon = induce(docs, labels)
    stays = on_texts("boolean", lambda texts: [round(lexicon.score(t), 6) < lexicon.threshold for t in texts])
    return docs.filter(stays(F.col("text").cast("string")))


def op7_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, toxic) of the documents found toxic, from scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = scores(docs, induce(docs, table(spark, sf_dir, "labels"))).select("doc_id", "score", "toxic")
    return written(judged, "toxic-scores").filter("toxic")  # small, and the texts go through small Arrow batches
