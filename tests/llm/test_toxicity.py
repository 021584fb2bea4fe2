"""Toxicity: seeds for any number of labels, support that comes through the walk, counts of distinct lines."""

import math
import random

import numpy as np
import pytest

from tidewheel.llm import toxicity
from tidewheel.llm.common import table, written


def walk(edges: dict[tuple[str, str], float], bad: list[str], good: list[str], restart: float = toxicity.RESTART) -> tuple[dict[str, float], dict[str, float]]:
    """The walk on the whole graph in one place: polarity, and the rate of visits from toxic seeds (0 without support), of every word of the graph, from random walks with restart.

    Support starts from the seeds and grows over the graph until no word joins."""
    names = sorted({w for e in edges for w in e} | set(bad) | set(good))
    if not names or not bad:
        return {}, {}
    at = {w: i for i, w in enumerate(names)}
    n = len(names)
    # either direction of an edge has its weight
    both = {(at[a], at[b]): x for (a, b), x in edges.items()}
    both |= {(j, i): x for (i, j), x in both.items()}
    keys = sorted(both)
    src, dst = np.array([k[0] for k in keys], int), np.array([k[1] for k in keys], int)
    weight = np.array([both[k] for k in keys])
    degree = np.bincount(src, weight, n) if len(keys) else np.zeros(n)

    def visits(start: list[str]) -> np.ndarray:
        s = np.zeros(n)
        if not start:
            return s
        np.add.at(s, [at[w] for w in start], 1 / len(start))
        p = s.copy()
        for _ in range(toxicity.STEPS):
            step = np.bincount(dst, (p / np.where(degree > 0, degree, 1))[src] * weight, n) if len(keys) else np.zeros(n)
            p = restart * s + (1 - restart) * (step + s * p[degree == 0].sum())
        return p

    plus, minus = visits(bad), visits(good)
    polarity = (plus - minus) / (plus + minus + toxicity.PRIOR * plus[[at[w] for w in bad]].mean())
    starts = np.zeros(n, bool)
    starts[[at[w] for w in bad]] = True
    found, size = starts, -1
    while found.sum() > size and len(keys):
        size = found.sum()
        strength = np.where(starts, 1.0, np.where(found, np.maximum(polarity, 0), 0))
        support = np.bincount(dst, strength[src], n)
        found = found | ((support >= min(toxicity.SUPPORT, starts.sum())) & (polarity > 0))
    polarity, plus = np.where(found, polarity, np.minimum(polarity, 0)), np.where(found, plus, 0)
    return dict(zip(names, polarity.tolist(), strict=True)), dict(zip(names, plus.tolist(), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_the_distributed_walk_is_that_on_the_whole_graph(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    edges, starts, frontiers = [], {}, {}
    for lang in ("en", "de", "xx"):
        bad, good = words[:5], words[5 : 9 - 4 * (lang == "de")]
        front = {*bad, *good, *r.sample(words[9:], 6)} if lang != "xx" else {*bad, *good}
        starts[lang], frontiers[lang] = (bad, good), front
        found = {}
        for a in sorted(front) if lang != "xx" else []:
            for b in r.sample(words, 14):
                if a != b and (b, a) not in found and a != "w4":
                    found[a, b] = r.random() * 3 + 0.1
        edges += [(lang, a, b, w) for (a, b), w in found.items() if b != "w4"]
    df = written(spark.createDataFrame(edges, "lang string, a string, b string, weight double"), "test-edges")
    lexicon, following = toxicity.walked(df, starts, frontiers, least=1e-9)
    for lang, (bad, good) in starts.items():
        polarity, visits = walk({(a, b): w for x, a, b, w in edges if x == lang}, bad, good)
        want = {w: v for w, v in polarity.items() if v >= 1e-9}
        assert lexicon[lang] == pytest.approx(want) and len(want) >= 5
        assert following[lang] == {w for w, rate in visits.items() if rate >= toxicity.PUSH} - frontiers[lang]


def test_the_lexicon_is_bounded_by_parameters():
    assert toxicity.SEEDS / (toxicity.PRIOR * toxicity.RESTART * toxicity.LEAST_WEIGHT) < 30_000


@pytest.mark.parametrize("times", [1, 4, 40])
def test_seeds_do_not_depend_on_the_number_of_labels(times):
    rows = [("en", f"a{i} walk by the lake {i % 7}" + (" you fiend" if i % 6 == 0 else ""), i % 6 == 0) for i in range(30 * times)]
    assert "fiend" in toxicity.seeds(rows)[0]
    assert toxicity.seeds([(x, t, not y) for x, t, y in rows if "fiend" not in t])[0] == []


def test_tests_of_seeds_are_exact_and_languages_add_up():
    p = toxicity.hypergeometric(3, 10, 4)
    assert abs(sum(p) - 1) < 1e-12 and abs(p[3] - math.comb(7, 1) / math.comb(10, 4)) < 1e-12
    # two toxic documents in each of five languages are too few alone
    rows = [(x, f"n{x}{'pqrstu'[i // 2]} walk" + (" fiend" if i < 2 else ""), i < 2) for x in "abcde" for i in range(12)]
    assert toxicity.seeds([r for r in rows if r[0] == "a"])[0] == []
    assert toxicity.seeds_by_language(rows)["a"][0] == ["fiend"]


def english(spark, size, train, held):
    """(caught, toxic, false) of the labelled English documents that held selects, by a lexicon of the labels that train selects."""
    docs = table(spark, f"/root/testdata/{size}", "documents").select("doc_id", "lang", "text")
    labels = table(spark, f"/root/testdata/{size}", "labels").select("doc_id", "toxic")
    lexicon = toxicity.induce(docs, labels.filter(train))
    marked = docs.filter("lang = 'en'").join(labels.filter(held).withColumnRenamed("toxic", "marked"), "doc_id")
    got = toxicity.scores(marked, lexicon).select("toxic", "marked").collect()
    return sum(r.toxic and r.marked > 0 for r in got), sum(r.marked > 0 for r in got), sum(r.toxic and r.marked == 0 for r in got)


def test_english_recall_with_seven_toxic_labels(spark):
    caught, toxic, false = english(spark, "sf0.001", "true", "true")
    assert caught >= 0.7 * toxic and not false


def test_english_recall_on_held_out_labels(spark):
    caught, toxic, false = english(spark, "sf0.01", "doc_id % 2 = 0", "doc_id % 2 = 1")
    assert caught >= 0.8 * toxic and not false


def test_support_comes_through_the_walk():
    first = {(x, p): 1.0 for x in ("x1", "x2", "x3") for p in ("p1", "p2", "p3", "p4", "p5")}
    second = {(p, w): 1.0 for p in ("p1", "p2", "p3", "p4", "p5") for w in ("q", "r")} | {("p1", "lone"): 1.0}
    polarity, visits = walk(first | second, ["x1", "x2", "x3"], ["y1"])
    assert polarity["q"] > 0 and polarity["r"] > 0 and visits["q"] > 0
    assert polarity["lone"] <= 0 and visits["lone"] == 0
    alone, _ = walk({("x1", "p1"): 1.0}, ["x1"], ["y1"])
    assert alone["p1"] > 0


def test_walk_prefers_the_seeds_side():
    edges = {(a, b): 1.0 for a in ("x1", "x2", "x3") for b in ("bad",)} | {("y1", "good"): 1.0, ("y1", "x1"): 0.1}
    polarity, _ = walk(edges, ["x1", "x2", "x3"], ["y1"])
    assert polarity["bad"] > 0 > polarity["good"] and polarity["x1"] > 0


def test_clean_neighbours_give_no_support():
    edges = {(x, p): 1.0 for x in ("x1", "x2", "x3") for p in ("p1", "p2")} | {(y, w): 1.0 for y in ("y1", "y2", "y3") for w in ("c1", "c2", "c3", "q")}
    polarity, _ = walk(edges | {("p1", "q"): 0.1}, ["x1", "x2", "x3"], ["y1", "y2", "y3"])
    assert polarity["p1"] > 0 and all(polarity[w] <= 0 for w in ("c1", "c2", "c3", "q"))


@pytest.mark.parametrize("full", [False, True])
def test_counts_are_of_the_same_lines(spark, full):
    lines = [f"fiend ghoul w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)] + ["fiend passage that all repeat"] * 1000 + ["plain talk here"] * 500
    lines += [f"calm {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    docs = spark.createDataFrame([(i, "en", x) for i, x in enumerate(lines)] + [(5000, "de", "fiend passage that all repeat\nRepeat, all that passage: fiend!"), (5001, None, None)], "doc_id long, lang string, text string")
    if full:  # a filter that rules nothing out
        repeated = toxicity.Repeated(spark.sparkContext.broadcast(b"\xff" * 16))
    else:
        repeated = toxicity.repeated_lines(docs)
    counts = toxicity.line_counts(docs, repeated)
    n = {(r.lang, r.word): r.n for r in counts.collect()}
    assert n["en", "fiend"] == 51 and n["en", "ghoul"] == 50 and n["en", ""] == 50 + 1 + 1 + 600 and n["de", ""] == 1
    edge = toxicity.neighbours(docs, {"en": {"fiend"}}, {"en": {"that"}}, counts, repeated).filter("b = 'ghoul'").collect()
    bound = 50 - toxicity.BOUND_Z * math.sqrt(50)
    assert [round(r.weight, 9) for r in edge] == [round(math.log(bound * 652 / (51 * 50) / toxicity.SHIFT), 9)]


def test_repeated_and_null_ids_and_clashing_columns(spark):
    bad = [(i, "en", f"you {w} and you rotten {v} person {i} walk") for i, (w, v) in enumerate([("fiend", "ghoul"), ("ghoul", "fiend"), ("fiend", "wretch"), ("wretch", "ghoul")] * 12)]
    good = [(1000 + i, "en", f"we saw {i} birds over the lake and a boat by pier {i * 3} then") for i in range(120)]
    rows = [*bad, *bad[:5], *good, (1000, "en", "you fiend you ghoul you wretch"), (None, "en", bad[0][2]), (None, "en", bad[0][2]), (None, "en", "a calm walk by the lake")]
    docs = spark.createDataFrame([(*r, "old", True) for r in rows], "doc_id long, lang string, text string, score string, toxic boolean")
    labels = spark.createDataFrame([(r[0], 1) for r in bad] + [(r[0], 0) for r in good] + [(None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.induce(docs, labels)
    assert lexicon.weights and len(toxicity.labelled(docs, labels)) == len(bad) + len(good)
    got = toxicity.scores(docs, lexicon)
    assert got.columns == docs.columns and dict(got.dtypes)["score"] == "double" and got.count() == len(rows)
    assert got.filter("toxic").count() == len(bad) + 5 + 1 + 2
    kept = toxicity.clean(docs, labels).collect()
    assert len(kept) == len(good) + 1 and {r.score for r in kept} == {"old"} and sum(r.doc_id is None for r in kept) == 1


def test_the_filter_knows_every_repeated_line(spark):
    r = random.Random(1)
    lines = [" ".join(r.sample(["ab", "cd", "ef", "gh", "ij", "kl"], 3)) for _ in range(60)] + [f"once x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = spark.createDataFrame([(i, "en", x) for i, x in enumerate(lines)], "doc_id long, lang string, text string")
    repeated = toxicity.repeated_lines(docs)
    keys = [toxicity.line_key("en", set(x.split())) for x in lines]
    assert all(k in repeated for k in keys if keys.count(k) > 1) and sum(k in repeated for k in keys if keys.count(k) == 1) < 10
