"""The pipeline's rows against a version in plain Python, stage by stage, which shares the trained models only."""

import hashlib
import math
from collections import defaultdict

import pyarrow as pa

import corpus_pipeline
from tidewheel.llm import mixing, near_dup, packing, pii, toxicity
from tidewheel.llm.common import table

from .test_against_brute_force import best_fit, whole_text_findings


def copies(docs):
    """doc -> times taken, by one sort of each source."""
    per = defaultdict(list)
    for r in docs:
        n = len(r["text"].split())
        if n:
            u = (int(hashlib.md5(f"{mixing.SEED}|{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            share = sum(c in mixing.SYMBOLS for c in r["text"]) / len(r["text"])
            per[r["source"]].append((-math.log(u) / max(mixing.LEAST_WEIGHT, 1 - 4 * share), r["doc_id"], n))
    tokens = {s: sum(x[2] for x in rows) for s, rows in per.items()}
    weight = {s: t**mixing.ALPHA for s, t in tokens.items()}
    share = {s: w / sum(weight.values()) for s, w in weight.items()}
    total = max(tokens[s] / share[s] for s in tokens)
    out = {}
    for s, rows in per.items():
        budget = math.ceil(round(total * share[s], 3))
        run = 0
        for _, doc, n in sorted(rows):
            run += n
            out[doc] = budget // tokens[s] + (run <= budget % tokens[s])
    return out


def test_pipeline_matches_plain_python(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]

    lexicon = toxicity.induce(docs, labels)
    rows = [r for r in rows if round(lexicon.score(r["text"]), 6) < lexicon.threshold]
    assert len(rows) < docs.count()

    at, sig = near_dup.signatures(pa.array([r["text"] for r in rows]))
    group = {int(i): int(i) for i in at}
    for x in range(len(at)):
        for y in ((sig[x + 1 :] == sig[x]).sum(1) >= near_dup.MATCHES).nonzero()[0] + x + 1:
            a, b = group[int(at[x])], group[int(at[y])]
            if a != b:
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    rows = [r for i, r in enumerate(rows) if group.get(i, i) == i]

    tag = pii.tagger()
    for r in rows:
        r["text"] = pii.masked(r["text"], whole_text_findings(tag, r["text"]))

    taken = copies(rows)
    want, lengths = [], []
    for r in rows:
        n = len(r["text"].split())
        for k in range(0, n, packing.CAPACITY):
            size = min(packing.CAPACITY, n - k)
            want += [(r["doc_id"], k // packing.CAPACITY, k, size)] * taken[r["doc_id"]]
            lengths += [size] * taken[r["doc_id"]]

    got = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(zip(got.doc_id, got.piece, got.token_start, got.n_tokens, strict=True)) == sorted(want)
    assert sorted(packing.CAPACITY - got.groupby("bin_id").n_tokens.sum()) == best_fit(lengths, packing.CAPACITY)
    ends = got.sort_values(["bin_id", "bin_offset"])
    same = ends.bin_id.eq(ends.bin_id.shift(-1))
    assert ((ends.bin_offset + ends.n_tokens)[same] <= ends.bin_offset.shift(-1)[same]).all()
