"""Quality classifier without gold labels.

Overlapping heuristic labellers vote good, bad or nothing on whole texts.
Expectation-maximisation over the counts of all vote patterns (3^labellers at most)
estimates the class prior and each labeller's vote probabilities (Dawid and Skene 1979). The
posterior labels train a logistic scorer over hashed byte 4-grams, which judges all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import release, slices, text_key
from docweave.session import store

#: (name, bad if the share is at least, good if it is at most); between them no vote.
LABELLERS = (
    ("symbols", 0.06, 0.01),  # # * $ % & and the like among all bytes
    ("shouting", 0.5, 0.15),  # capitals among ASCII letters
    ("marks", 0.05, 0.01),  # ! and ? among all bytes
    ("pipes", 0.04, 0.005),  # table bars among all bytes
    ("letters", 0.4, 0.25),  # anything but letters and blanks among all bytes
    ("copied_lines", 0.5, 0.2),  # repeats among lines
    ("one_word", 0.4, 0.2),  # the commonest word among all words
)
FEATURES = 1 << 16
#: At most so many texts, chosen by a hash of the id, train the scorer.
TRAIN_DOCS = 4000
_SYMBOLS, _MARKS = np.frombuffer(b"#*$%&<>{}\\~^=_+@", np.uint8), np.frombuffer(b"!?", np.uint8)


def votes_of(text: str) -> tuple[int, ...]:
    """A vote of each labeller: 1 bad, 0 good, -1 none. An empty text gets no votes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (-1,) * len(LABELLERS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, upper, lower, blank = len(data), count[65:91].sum(), count[97:123].sum(), count[32] + count[9:14].sum()
    lines = data.split(b"\n")
    _, top = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)
    shares = (
        count[_SYMBOLS].sum() / n, upper / max(1, upper + lower), count[_MARKS].sum() / n, count[124] / n,
        1 - (upper + lower + blank + count[128:].sum()) / n, 1 - len(set(lines)) / len(lines), top.max() / len(words) if len(words) >= 20 else 0.3,
    )
    return tuple(1 if s >= bad else 0 if s <= good else -1 for s, (_, bad, good) in zip(shares, LABELLERS, strict=True))


def _pattern(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def fit_labellers(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], float, np.ndarray]:
    """(posterior of bad per pattern, prior of bad, vote probabilities [class, labeller, vote])."""
    keys = sorted(patterns)
    if not keys:
        return {}, 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[k // 3**j % 3 for j in range(len(LABELLERS))][::-1] for k in keys])
    seen = np.stack([votes == v for v in range(3)], 2).astype(float)  # 0 none, 1 good, 2 bad
    bad, good = (votes == 2).sum(1), (votes == 1).sum(1)
    q = np.where(bad > 0, 0.5 + 0.45 * (bad >= 1), np.where(good > 0, 0.05, 0.5))
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + 2)
        p = np.stack([np.einsum("i,ijv->jv", n * w, seen) + 0.1 for w in (1 - q, q)])
        p /= p.sum(2, keepdims=True)
        log = np.einsum("ijv,cjv->ic", seen, np.log(p)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    q = np.where(bad + good == 0, 0.5, q)  # no vote, no label
    return dict(zip(keys, q.tolist(), strict=True)), float(prior), p


def features_of(data: bytes) -> np.ndarray:
    """Hash buckets of all byte 4-grams of a text with a blank at both ends."""
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(1, np.int64)
    h = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


#: Training texts whose entries are expanded at once.
CHUNK = 256


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 60, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over mean 4-gram weights, by Adagrad steps on the
    posterior labels. rows: (buckets, shares, posterior of bad), kept in their small types;
    gradients add up over ``CHUNK`` rows at a time."""
    w, b = np.zeros(FEATURES), 0.0
    if not rows:
        return w.astype(np.float32), b
    y = np.array([r[2] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(rows)
    chunks = []
    for i in range(0, len(rows), CHUNK):
        some = rows[i : i + CHUNK]
        begin = np.cumsum([0] + [len(r[0]) for r in some])[:-1]
        chunks.append((slice(i, i + len(some)), np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some]), begin))
    seen, seen_b = np.full(FEATURES, 1e-12), 1e-12
    for _ in range(rounds):
        g, total = l2 * w / len(rows), 0.0
        for at, index, value, begin in chunks:
            raw = np.add.reduceat(w[index] * value, begin) + b
            d = weight[at] * (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y[at])
            g += np.bincount(index, np.repeat(d, np.diff([*begin, len(index)])) * value, FEATURES)
            total += d.sum()
        seen += g * g
        seen_b += total**2
        w -= 2.0 * g / np.sqrt(seen)
        b -= 0.2 * total / np.sqrt(seen_b)
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of bad per vote pattern, weights, bias): votes on all texts, EM over the
    counts of their patterns, then the scorer on at most ``train_docs`` labelled rows."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("t"))

    def vote(batches):
        for batch in slices(batches):
            patterns = [_pattern(votes_of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(patterns, pa.int32())], ["doc_id", "t", "pattern"])

    voted = store(chosen.mapInArrow(vote, "doc_id bigint, t bigint, pattern int"), "votes")
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = fit_labellers(counts)
    labelled = [p for p, q in posterior.items() if q != 0.5]
    usable = voted.where(F.col("doc_id").isNotNull() & F.col("pattern").isin(labelled or [-1]))
    # A row is known by its id and text, so a repeated id sends one row for each of its texts,
    # and the rows are cut to the bound before any text is fetched.
    picked = usable.dropDuplicates(["doc_id", "t"]).orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(train_docs)

    def shares(batches):
        for batch in slices(batches, 100):
            out = [np.unique(features_of((t or "").encode("utf-8", "surrogatepass")), return_counts=True) for t in batch.column(3).to_pylist()]
            index = pa.array([i.astype(np.uint16).tobytes() for i, _ in out], pa.binary())
            value = pa.array([(c / c.sum()).astype(np.float32).tobytes() for _, c in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], index, value], ["doc_id", "t", "pattern", "buckets", "shares"])

    train = chosen.join(F.broadcast(picked), ["doc_id", "t"]).select("doc_id", "t", "pattern", "text")
    train = train.groupBy("doc_id", "t", "pattern").agg(F.first("text").alias("text"))  # repeated rows
    train = train.mapInArrow(shares, "doc_id bigint, t bigint, pattern int, buckets binary, shares binary")
    rows = [(r.doc_id, r.t, np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.shares, np.float32), posterior[r.pattern]) for r in train.toLocalIterator()]
    rows = [r[2:] for r in sorted(rows, key=lambda r: r[:2])]
    weights, bias = fit_scorer(rows)
    del rows
    release()  # the driver lives on
    return posterior, weights, bias


def judge_text(text: str | None, model: tuple, threshold: float) -> tuple[int, int, float, float, bool]:
    """(votes_bad, votes_good, posterior, score, kept) of a text."""
    posterior, weights, bias = model
    text = text or ""
    votes = votes_of(text)
    raw = weights[features_of(text.encode("utf-8", "surrogatepass"))].mean(dtype=np.float64) + bias
    score = float(1 / (1 + np.exp(-np.clip(raw, -50, 50)))) if text.split() else 1.0
    return votes.count(1), votes.count(0), posterior.get(_pattern(votes), 0.5), score, score < threshold


def classify(docs: DataFrame, threshold: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, votes_bad, votes_good, posterior, score, kept) of every document.

    ``score`` is the scorer's probability of bad, ``kept`` is score < threshold. Two narrow
    passes over whole texts; the driver holds pattern counts and the bounded training rows.
    Null, empty and blank texts get no votes, posterior 0.5 and score 1, and are not kept.
    A null ``doc_id`` stays, repeated rows give repeated results, other columns are ignored.
    An empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())

    def judge(batches):
        for batch in slices(batches):
            columns = zip(*(judge_text(t, known.value, threshold) for t in batch.column(1).to_pylist()), strict=True)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "votes_bad", "votes_good", "posterior", "score", "kept"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(judge, "doc_id bigint, votes_bad int, votes_good int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows that ``classify`` keeps, with all of their columns and without a join."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))
    at = docs.columns.index("text")

    def judge(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([judge_text(t, known.value, threshold)[4] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
