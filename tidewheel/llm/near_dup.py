"""Near-duplicate search: an inverted join over the coordinates of MinHash signatures.

Every document has COORDS minima over its word shingles; two documents whose signatures agree in at
least MATCHES coordinates are near copies. Documents are posted under their (coordinate, value) pairs:
- pairs that one document alone has are dropped; a document with fewer than MATCHES shared ones has no partner;
- prefix: of its n shared pairs, ordered from the rarest to the most frequent, a document posts the first
  n - MATCHES + HITS; two documents that agree in MATCHES meet in at least HITS of these. Values of a passage
  that very many documents hold come last in this order, so that they are not posted;
- skipping: of two documents that met, those that neither has posted are at most MATCHES - HITS more, so that documents that
  collide in fewer than HITS are dropped by their count alone, without a look at the lists beyond the prefix. The others
  are compared once.
This is exact for the signatures: no list and no number of partners is capped. Documents with equal
signatures are one node, so that a group of exact copies costs no pairs.

Cost: values are counted by partial sums. Those with more than one in HOT_VALUES of all rows are at most HOT_VALUES and are broadcast to
the rows that hold them, so that no task gets all rows of a value; the others meet their rows by a shuffle.

The query gives classes(): a row for each document with its class and the number of its links, so that the result grows with the
documents, however many pairs a cluster has; links to and between copies are counted, not made.

Defined cases: null texts and texts without a word match nothing, are always kept, and are classes of their own without links; a text
with fewer words than a shingle has one shingle; case, punctuation and white space don't matter; rows without an id are
in no pair but take part in dedup() and classes(); rows that repeat an id are separate documents in both and make no pair with
themselves; an empty table gives an empty result; other columns pass through dedup() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import pieces, table, whole, written

COORDS = 64
MATCHES = 32
#: Collisions in the prefixes that two documents need at least.
HITS = 3
#: Most values that are broadcast with their counts.
HOT_VALUES = 10_000
SHINGLE = 3
#: Bytes of text, and shingles, that numpy handles at once.
BLOCK_BYTES, BLOCK_SHINGLES = 1 << 20, 1 << 13

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_A, _B = _odd(COORDS, 1)[:, None], _odd(COORDS, 2)[:, None]
_C = _odd(64, 3)
_R = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in the bytes, and where each word starts; no word goes across a document's start."""
    hashes, at = [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK_BYTES)
        while hi < n:  # a block ends before something that is no word, or with a document
            stop = np.flatnonzero(~_WORD[data[hi : hi + 4096]])
            if len(stop):
                hi += int(stop[0])
                break
            hi = min(n, hi + 4096)
        block = _LOWER[data[lo:hi]]
        is_word = _WORD[block]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        docs = starts_of_docs[np.searchsorted(starts_of_docs, lo) : np.searchsorted(starts_of_docs, hi)] - lo
        first[docs[is_word[docs]]] = True
        i = np.flatnonzero(first)
        if len(i):
            inside = np.flatnonzero(is_word)
            word = np.cumsum(first[inside]) - 1
            place = inside - i[word]
            powers = np.ones(int(place.max()) + 1, np.uint64)
            np.multiply.accumulate(np.full(len(powers) - 1, _R), out=powers[1:]) if len(powers) > 1 else None
            sums = np.add.reduceat((block[inside].astype(np.uint64) + np.uint64(1)) * powers[place], np.searchsorted(inside, i))
            hashes.append(_mix(sums))
            at.append(i + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(at)


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """COORDS minima for each run of shingles that starts at one of starts (none is empty)."""
    out = np.full((len(starts), COORDS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), BLOCK_SHINGLES):
        part = shingles[lo : lo + BLOCK_SHINGLES]
        first = np.searchsorted(starts, lo, "right") - 1
        last = np.searchsorted(starts, lo + len(part), "left")
        cuts = np.maximum(starts[first:last] - lo, 0)
        values = part[None, :] * _A
        values += _B
        out[first:last] = np.minimum(out[first:last], np.minimum.reduceat(values, cuts, axis=1).T)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indices of texts that hold a word, and their signatures."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    hashes, at = word_hashes(data, np.unique(starts))
    bounds = np.searchsorted(at, offsets)
    count = np.diff(bounds)
    keep = np.flatnonzero(count)
    if not len(keep):
        return keep, np.zeros((0, COORDS), np.int32)
    n = len(hashes)
    sums = hashes * _C[0]
    doc = np.repeat(np.arange(len(count)), count)
    for k in range(1, SHINGLE):
        same = np.zeros(n, bool)
        same[: n - k] = doc[k:] == doc[: n - k]
        sums[same] += hashes[k:][same[: n - k]] * _C[k]
    # a shingle starts at each word but a document's last ones; a short document has one
    valid = np.arange(n) - bounds[doc] <= np.maximum(count[doc] - SHINGLE, 0)
    kept = np.maximum(count[keep] - SHINGLE + 1, 1)
    return keep, minima(_mix(sums[valid]), np.concatenate([[0], np.cumsum(kept)[:-1]]))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        at, sig = signatures(b.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * COORDS, pa.int32()), pa.array(sig.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), b.column("h").take(pa.array(at)), flat], ["doc_id", "h", "sig"])


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, h, sig) of all texts with a word; h: digest of the text."""
    light = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return written(light.mapInArrow(_sign, f"doc_id {kind}, h long, sig array<int>"), "near-signatures")


def _sign_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        at, sig = signatures(b.column("text"))
        none = np.ones(b.num_rows, bool)
        none[at] = False
        ends = np.concatenate([[0], np.cumsum(~none) * COORDS])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig.ravel(), pa.int32()), mask=pa.array(none))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), lists], ["row", "doc_id", "sig"])


def sign_all(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sig) of all rows, with a number for each; sig is null for texts without a word."""
    light = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return written(light.mapInArrow(_sign_all, f"row long, doc_id {kind}, sig array<int>"), "near-signatures")


def nodes_of(signed: DataFrame) -> DataFrame:
    """(node, sig): a node for each signature."""
    return written(signed.select("sig").distinct().withColumn("node", F.monotonically_increasing_id()), "near-nodes")


def agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def postings(nodes: DataFrame, matches: int, hits: int) -> DataFrame:
    """(pair, node): each node under the pairs of its prefix."""
    rows = nodes.select("node", F.posexplode("sig").alias("c", "v")).select("node", (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long")).alias("pair"))
    counts = written(rows.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"), "near-values")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    often = F.col("n") > F.lit(total / HOT_VALUES)
    hot = counts.filter(often)
    shared = rows.join(F.broadcast(hot), "pair").unionByName(rows.join(F.broadcast(hot), "pair", "left_anti").join(counts.filter(~often), "pair"))
    return (
        shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("s"))
        .filter(F.size("s") >= matches)
        .select("node", F.explode(F.slice("s", F.lit(1), F.size("s") - (matches - hits))).alias("x"))
        .select("x.pair", "node")
    )


def edges(nodes: DataFrame, matches: int = MATCHES, hits: int = HITS) -> DataFrame:
    """(a, b, matches) for all pairs of nodes that agree in enough coordinates; a < b. The number of hits changes the cost only."""
    hits = min(hits, matches)
    posted = written(postings(nodes, matches, hits), "near-postings")
    met = (
        posted.withColumnRenamed("node", "a")
        .join(posted.withColumnRenamed("node", "b"), "pair")
        .filter("a < b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("collisions"))
        .filter(F.col("collisions") >= hits)
    )
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    return (
        met.join(sig("a"), "a").join(sig("b"), "b")
        .withColumn("matches", agreeing(F.col("sig_a"), F.col("sig_b")).cast("long"))
        .filter(F.col("matches") >= matches)
        .select("a", "b", "matches")
    )


def pairs(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(doc_a, doc_b, matches): near copies, doc_a < doc_b.

    Documents with equal signatures are given as pairs with the least id among them, which stands for
    them in the pairs with others. Where one id, being repeated, would stand for both sides, all their documents are paired.
    classes() counts the links of every document, those between members of such groups included.
    """
    signed = sign(docs)
    nodes = nodes_of(signed)
    ids = signed.filter("doc_id is not null").select("doc_id", "sig").join(nodes, "sig").select("node", "doc_id").distinct()
    ids = written(ids.withColumn("rep", F.min("doc_id").over(Window.partitionBy("node"))), "near-ids")
    reps = lambda x: ids.filter("doc_id = rep").select(F.col("node").alias(x), F.col("rep").alias(f"doc_{x}"))
    found = written(edges(nodes, matches).join(reps("a"), "a").join(reps("b"), "b"), "near-found")
    members = lambda x: ids.select(F.col("node").alias(x), F.col("doc_id").alias(f"doc_{x}"))
    alike = found.filter("doc_a = doc_b").select("a", "b", "matches").join(members("a"), "a").join(members("b"), "b").select("doc_a", "doc_b", "matches")
    both = found.select("doc_a", "doc_b", "matches").unionByName(alike).filter("doc_a != doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "matches").unionByName(
        ids.filter("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(COORDS).cast("long").alias("matches"))
    )


def components(found: DataFrame) -> DataFrame:
    """(node, group) of all nodes in pairs (a, b): group is the least node that can be reached.

    Each round gives a node the least label near it, then the label of that label; a round reads and
    writes one table in the shared folder. Rounds grow with the logarithm of a chain's length.
    """
    both = written(found.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("to"))), "near-edges")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("to")).alias("group")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "group"), "to").groupBy("node").agg(F.min("group").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("further"))
        moved = written(hop.join(jump, "group", "left").select("node", "old", F.least("group", F.coalesce("further", "group")).alias("group")), "near-labels")
        labels = moved.select("node", "group")
        if moved.filter(F.col("group") != F.col("old")).isEmpty():
            return labels


def groups(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(doc_id, group) of all documents with a word and an id: documents of a group are near copies, directly or over others.

    Beside pairs(), where documents with equal signatures are named by their least id only, this tells of any two documents whether they belong together."""
    signed = sign(docs)
    nodes = nodes_of(signed)
    found = components(edges(nodes, matches))
    return signed.filter("doc_id is not null").join(nodes, "sig").join(found, "node", "left").select("doc_id", F.coalesce("group", "node").alias("group")).distinct()


def classes(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(doc_id, class_id, n_links) of all rows of docs.

    n_links: the number of other rows whose signatures agree with the row's in enough coordinates, those with equal signatures included;
    rows with the same class_id, and no others, are near copies, directly or over others. class_id is the number of the class's first row."""
    signed = sign_all(docs)
    nodes = written(signed.filter("sig is not null").groupBy("sig").agg(F.min("row").alias("node"), F.count("*").alias("size")), "near-nodes")
    found = written(edges(nodes.select("node", "sig"), matches), "near-links")
    ends = found.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("to")))
    others = ends.join(nodes.select(F.col("node").alias("to"), "size"), "to").groupBy("node").agg(F.sum("size").alias("others"))
    named = (
        nodes.join(components(found), "node", "left").join(others, "node", "left")
        .select("sig", F.coalesce("group", "node").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    lone = signed.filter("sig is null").select("doc_id", F.col("row").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return signed.filter("sig is not null").join(named, "sig").select("doc_id", "class_id", "n_links").unionByName(lone)


def dedup(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least id (then least digest); texts without words stay."""
    signed = sign(docs)
    nodes = nodes_of(signed)
    groups = components(edges(nodes, matches))
    grouped = (
        signed.join(nodes, "sig").select("doc_id", "h", "node")
        .join(groups, "node", "left")
        .select("doc_id", "h", F.coalesce("group", "node").alias("group"))
    )
    order = Window.partitionBy("group").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    ranked = written(grouped.withColumn("place", F.row_number().over(order)).filter("place > 1").select("doc_id", "h", "group")
                     .join(grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("first")), "group"), "near-ranked")
    kept_key = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    dropped = ranked.filter(~kept_key).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    repeated = ranked.filter(kept_key).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(whole(docs), F.col("doc_id").alias("_a"), F.xxhash64("text").alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_h"))
    kept = rows.join(dropped, same, "left_anti")
    if not repeated.isEmpty():  # of rows that are equal in id and text one stays
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["_a", "_b"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select("_row.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
