"""Quality rules by sequence labelling: a linear-chain conditional random field marks each line as content or boilerplate.

The lines of a document are its sequence; their features are classes of length, symbols, capitals, digits,
repeated words, repeated lines, endings, and of the document's words. Labels are known for documents, not for lines, so that the
lines' labels are latent: the field is trained when the operator is planned, on at most SAMPLE labelled documents (those with the least
digests), in rounds. First lines alone learn from their documents' labels; then each round labels the lines by the probabilities of the round
before, under the document's label, and trains the field on these. Under a good label at least KEEP_SHARE of a document's characters
are content, under a bad one less than that: where the probabilities say otherwise, the lines that speak most for it give way.
A document stays if at least KEEP_SHARE of its characters are in lines that Viterbi's recursion marks as content.

Cost: one scan without a shuffle; what the driver gathers is bounded by SAMPLE.

Defined cases: null and blank texts have no lines, a share of 0, and don't stay; blank lines are skipped; very long texts are decoded whole; without
labelled documents of both kinds every line counts as content; a null id is kept; rows that repeat an id each
have their own row, and where such an id is labelled, its least text teaches; an empty table gives an empty result; other columns pass
through ``filtered`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import crf
from tidewheel.llm.common import on_texts, pieces, table

SAMPLE = 3000
KEEP_SHARE = 0.5
#: Trainings of the field on lines labelled by the one before.
ROUNDS = 2
#: Lines of a training sequence; longer documents are cut.
PART = 64
#: Upper bounds of the classes of each measure.
CLASSES = [
    np.array([1, 2, 4, 8, 16, 32, 64, 128]),  # words
    np.array([0, 0.01, 0.03, 0.06, 0.12, 0.25]),  # symbols to characters
    np.array([0, 0.02, 0.05, 0.1, 0.2, 0.4]),  # capitals to characters
    np.array([0, 0.02, 0.1, 0.3]),  # digits to characters
    np.array([0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.99]),  # distinct words to words
    np.array([1, 2, 5]),  # times that the line is in the document
    np.array([0, 1, 2]),  # ending: sentence, other letter, other
    np.array([8, 16, 32, 64]),  # words of the document
]
_OFFSETS = np.cumsum([0, *(len(c) + 1 for c in CLASSES)])
#: Distinct words tell little in a short line: their classes are apart for short, middle and long lines.
N_FEATURES = int(_OFFSETS[-1]) + 3 * (len(CLASSES[4]) + 1)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"!#$%&*+/<=>@[\\]^_`{|}~"


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


def measures(lines: list[str]) -> np.ndarray:
    """A row of measures for each line."""
    times = Counter(lines)
    out = np.empty((len(lines), len(CLASSES)))
    for row, line in zip(out, lines, strict=True):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw)
        words = line.split()
        row[0] = len(words)
        row[1] = (n - len(raw.translate(None, _SYMBOL))) / n
        row[2] = (n - len(raw.translate(None, _UPPER))) / n
        row[3] = (n - len(raw.translate(None, _DIGIT))) / n
        row[4] = len(set(words)) / len(words)
        row[5] = times[line]
        end = line.rstrip()[-1]
        row[6] = 0 if end in ".!?:;" else 1 if end.isalnum() else 2
    out[:, 7] = out[:, 0].sum()
    return out


def features(lines: list[str]) -> np.ndarray:
    m = measures(lines)
    ids = np.empty((len(lines), len(CLASSES) + 1), np.int64)
    for k, c in enumerate(CLASSES):
        ids[:, k] = np.searchsorted(c, m[:, k]) + _OFFSETS[k]
    ids[:, -1] = _OFFSETS[-1] + np.searchsorted([8, 64], m[:, 0]) * (len(CLASSES[4]) + 1) + np.searchsorted(CLASSES[4], m[:, 4])
    return ids


def lines_labelled(content: np.ndarray, good: bool, sizes: np.ndarray, keep_share: float = KEEP_SHARE) -> np.ndarray:
    """1 for content and 0 for boilerplate, by the lines' probabilities of content, so that the share of characters agrees with the document's label."""
    marks = (content >= 0.5).astype(int)
    total = sizes.sum()
    for i in np.argsort(-content if good else content, kind="stable"):
        if ((sizes * marks).sum() >= keep_share * total) == good:
            break
        marks[i] = int(good)
    return marks


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> crf.Model | None:
    """A field from at most ``sample`` labelled documents; None without documents of both kinds."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # the sample bounds it
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    pairs = [(x, r.quality > 0) for r in rows if (x := lines_of(r.text))]
    return fitted([x for x, _ in pairs], [q for _, q in pairs])


def fitted(split: list[list[str]], good: list[bool], rounds: int = ROUNDS) -> crf.Model | None:
    if len(set(good)) < 2:
        return None
    seqs = [features(x) for x in split]
    sizes = [np.array([len(line) for line in x]) for x in split]
    alone = [x[i : i + 1] for x in seqs for i in range(len(x))]
    lines = crf.train(alone, [np.array([int(q)]) for x, q in zip(seqs, good, strict=True) for _ in x], N_FEATURES, 2, l2=1.0)
    ends = np.cumsum([len(x) for x in seqs])[:-1]
    content = np.split(np.array([p[0, 1] for p in crf.marginals(alone, lines)]), ends)
    cut = lambda xs: [x[i : i + PART] for x in xs for i in range(0, len(x), PART)]
    model = None
    for _ in range(rounds):
        marks = [lines_labelled(p, q, n) for p, q, n in zip(content, good, sizes, strict=True)]
        model = crf.train(cut(seqs), cut(marks), N_FEATURES, 2, l2=1.0)
        content = [p[:, 1] for p in crf.marginals(seqs, model)]
    return model


def shares(texts: list[str | None], model: crf.Model | None) -> list[tuple[int, int, float]]:
    """(lines, content lines, content share of characters) of each text."""
    split = [lines_of(t) for t in texts]
    marks = [np.ones(len(x), np.int8) for x in split] if model is None else crf.decode([features(x) for x in split], model)
    out = []
    for x, m in zip(split, marks, strict=True):
        sizes = np.array([len(line) for line in x], np.int64)
        out.append((len(x), int(m.sum()), float((sizes * m).sum() / sizes.sum()) if len(x) else 0.0))
    return out


def judge(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(doc_id, n_lines, n_content, content_share, keep) for every document."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = shares(part.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([round(r[2], 6) for r in rows], pa.float64()), pa.array([r[0] > 0 and r[2] >= keep_share for r in rows], pa.bool_())],
                ["doc_id", "n_lines", "n_content", "content_share", "keep"],
            )

    light = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return light.mapInArrow(run, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, n_lines long, n_content long, content_share double, keep boolean")


def filtered(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of docs, with all columns, that stay."""
    model = fit(docs, labels)

    stays = on_texts("boolean", lambda texts: [n > 0 and s >= keep_share for n, _, s in shares(texts, model)])
    return docs.filter(stays(F.col("text").cast("string")))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
