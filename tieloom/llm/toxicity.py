"""Toxicity by weak supervision.

1. Terms (words, and word beginnings of 4 to 9 letters) that mark toxic texts are mined from a
   bounded sample of labelled training rows, counted per task before they are summed.
2. Terms are grouped by stem into voters; fixed word lists and surface patterns vote too. A
   voter says "toxic" or nothing. There are at most 16, so all documents together give at most
   65,536 patterns of votes, counted by Spark over every training document.
3. A generative label model is fitted to these counts by expectation maximization: the accuracy
   of each voter's votes, and the correlation of each pair of voters within a class. Silence says
   nothing, as voters of one language are silent on all others; one voter speaks where all others
   are silent. A voter counts the less, the more it repeats others. Labelled training texts count
   beside the expected ones.
4. A logistic regression on the terms is trained on the posterior labels of a bounded sample of
   training rows and scores every text.

Texts are read whole, lower-cased. Null and empty texts have no terms and get the score of such
texts. Null labels are no labels. Without any toxic label in training, mined terms are missing
and the fixed lists alone decide. Repeated rows are scored alike; no column but the text enters
a score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.tables import in_small_batches
from tieloom.llm.words import slices
from tieloom.staging import staged

# General English insults, as a voter of its own.
INSULTS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "filthy", "garbage", "imbecile")
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
MAX_VOTERS = 16
#: Lengths of the word beginnings that are terms, written with a star.
PREFIXES = range(4, 10)


@dataclass
class Voters:
    """Terms by id, and the voter of each term. After the mined voters come the fixed list, two
    surface patterns, and the one that votes where no other does."""

    terms: dict[str, int] = field(default_factory=dict)
    voter: list[int] = field(default_factory=list)
    count: int = 0


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray


def _words(text: str) -> set[str]:
    return {w.strip(_STRIP) for w in set(text.lower().split())}


def _terms(words: set[str]) -> set[str]:
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    out.discard("")
    return out


def mine_terms(labelled: DataFrame, most: int = 512) -> tuple[dict[str, tuple[int, int]], int, int]:
    """Terms of ``labelled`` (``text, toxic``; bounded) that mark toxic texts, with the numbers
    of toxic and other texts that hold them; and the numbers of texts."""

    def count(batches):
        for batch in slices(batches, 0):
            found = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(_terms(_words(text or "")))
            # a term seen in other texts only is of no use; the counts of the rest must be whole
            keys = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())],
                ["term", "toxic", "other"],
            )

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, round(0.01 * n1))
    rows = (
        labelled.select("text", "toxic").mapInArrow(count, "term string, toxic bigint, other bigint")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= least) & (F.col("other") * max(n1, 1) <= F.col("toxic") * max(n0, 1) * 0.02))
        .orderBy(F.desc("toxic"), "term").limit(most).collect()
    )
    return {r["term"]: (r["toxic"], r["other"]) for r in rows}, n1, n0


def make_voters(mined: dict[str, tuple[int, int]]) -> Voters:
    """One voter per stem of the strongest stems, one for all other terms, one for the fixed list."""
    stems = Counter()
    for term, (n, _) in mined.items():
        stems[term[:4].rstrip("*")] = max(stems[term[:4].rstrip("*")], n)
    own = {stem: i for i, (stem, _) in enumerate(sorted(stems.items(), key=lambda x: (-x[1], x[0]))[: MAX_VOTERS - 5])}
    rest = len(own)
    out = Voters(count=rest + 5)
    for term in mined:
        out.terms[term] = len(out.voter)
        out.voter.append(own.get(term[:4].rstrip("*"), rest))
    for word in INSULTS:
        if word not in out.terms:
            out.terms[word] = len(out.voter)
            out.voter.append(rest + 1)
    return out


def read_texts(docs: DataFrame, voters: Voters) -> DataFrame:
    """Adds to ``doc_id, held_out`` the array ``terms`` of term ids and the bit pattern ``votes``."""
    insults = frozenset(INSULTS)

    def run(batches):
        table, voter, last = voters.terms, voters.voter, voters.count
        begins = {t[:3] for t in table}
        lengths = [n for n in PREFIXES if any(len(t) == n + 1 and t[-1] == "*" for t in table)]
        for batch in slices(batches, 2):
            ids, votes = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                words = _words(text)
                hits = set()
                for w in words:
                    if w[:3] in begins:
                        for key in (w, *[w[:n] + "*" for n in lengths if n <= len(w)]):
                            if (i := table.get(key)) is not None:
                                hits.add(i)
                mask = 0
                for i in hits:
                    mask |= 1 << voter[i]
                mask |= (not insults.isdisjoint(words)) << (last - 4)
                mask |= ("!!" in text) << (last - 3)
                mask |= text.isupper() << (last - 2)
                mask |= (mask == 0) << (last - 1)
                ids.append(sorted(hits))
                votes.append(mask)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(votes, pa.int32())],
                ["doc_id", "held_out", "terms", "votes"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {key}, held_out boolean, terms array<int>, votes int")


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, n_voters: int, prior: float, yes: np.ndarray, no: np.ndarray, rounds: int = 60):
    """Posterior of each vote pattern, accuracy of each voter's votes, and correlations of voters.

    A voter that keeps silent says nothing; its vote multiplies the odds by accuracy over prior
    odds. ``yes`` and ``no`` are the labelled texts that it voted on, by label. They weigh twice as
    much as all its other votes together, as a voter that is often alone would else confirm itself. The correlation of a pair within a class comes from the first
    fit; in the second a voter's log odds are divided by one plus its correlations with the voters
    before it.
    """
    votes = (patterns[:, None] >> np.arange(n_voters)) & 1
    logit = lambda p: np.log(p / (1 - p))
    cast, known = counts @ votes, yes + no
    share = np.where(known > 0, np.minimum(1, known / np.maximum(2 * cast, 1)), 1)
    discount, correlation = np.ones(n_voters), np.zeros((n_voters, n_voters))
    for fit in range(2):
        accuracy = (yes + prior) / (yes + no + 1)
        for _ in range(rounds):
            z = logit(prior) + votes @ ((logit(np.clip(accuracy, 1e-4, 1 - 1e-4)) - logit(prior)) * discount)
            post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            accuracy = (share * ((counts * post) @ votes) + yes + prior) / (share * cast + known + 1)
        if fit == 0:
            for p in (post, 1 - post):
                w = counts * p / max((counts * p).sum(), 1e-9)
                dev = votes - w @ votes
                cov = (dev * w[:, None]).T @ dev
                scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
                correlation = np.maximum(correlation, np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-12))
            np.fill_diagonal(correlation, 0)
            discount = 1 / (1 + np.tril(correlation).sum(1))
    return post, accuracy, correlation


def fit_logistic(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, width: int, ridge: float = 0.002, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on soft labels; ``rows`` hold the term ids of each text."""
    x = np.zeros((len(rows), width + 1))
    x[:, width] = 1
    for i, ids in enumerate(rows):
        x[i, ids] = 1
    weight = weight / weight.sum() * len(rows)
    penalty = np.full(width + 1, ridge * 10)
    penalty[width] = 1e-6
    beta = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - penalty * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:width], float(beta[width])


@in_small_batches
def score_texts(
    docs: DataFrame, labels: DataFrame, held_out, labelled_rows: int = 12_000, fitted_rows: int = 12_000, most_terms: int = 512
) -> tuple[DataFrame, Model]:
    """Scores every row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score``; and the model.

    ``held_out`` is a Column of ``doc_id``: rows never learned from. ``labelled_rows`` bounds the
    labelled rows that terms are mined from, half of them toxic if there are as many;
    ``fitted_rows`` bounds the rows of the regression. Both are chosen by a hash of the id.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out).dropDuplicates(["doc_id"])
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows // 2) for y in (1, 0)]
    sample = staged(docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("text", "toxic"), "labelled")
    mined, n1, n0 = mine_terms(sample, most_terms)
    voters = make_voters(mined)

    read = staged(read_texts(docs, voters), "terms")
    training = read.where(~F.col("held_out"))
    counted = training.groupBy("votes").count().collect()  # at most 2 ** MAX_VOTERS rows
    patterns = np.array([r["votes"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], float)
    if not len(patterns):
        patterns, counts = np.zeros(1, np.int64), np.ones(1)
    yes, no = np.zeros(voters.count), np.zeros(voters.count)
    for r in training.join(known, "doc_id").groupBy("votes", "toxic").count().collect():  # twice as many at most
        (yes if r["toxic"] else no)[[j for j in range(voters.count) if r["votes"] >> j & 1]] += r["count"]
    prior = (sizes.get(1, 0) + 1) / (sizes.get(1, 0) + sizes.get(0, 0) + 10)
    if not sizes.get(1):  # no toxic label: the fixed list is taken at its word
        yes[-4], no[-1] = 99, 999
    post, accuracy, correlation = fit_label_model(patterns, counts, voters.count, prior, yes, no)
    of = dict(zip(patterns.tolist(), post.tolist(), strict=True))

    toxic_patterns = [int(p) for p, q in of.items() if q > 0.5]
    is_toxic = F.col("votes").isin(toxic_patterns) if toxic_patterns else F.lit(False)
    rows, weight = [], []
    for side in (is_toxic, ~is_toxic):
        part = training.where(side)
        total = part.count()
        got = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted_rows // 2).select("terms", "votes").collect()
        rows += got
        weight += [total / max(len(got), 1)] * len(got)
    if rows:
        beta, bias = fit_logistic([r["terms"] for r in rows], np.array([of[r["votes"]] for r in rows]), np.array(weight), len(voters.voter))
    else:
        beta, bias = np.zeros(len(voters.voter)), -3.0
    table = F.array(*[F.lit(float(b)) for b in beta])
    z = F.aggregate("terms", F.lit(bias), lambda total, i: total + F.get(table, i))
    scored = read.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
    return scored, Model(voters, beta, bias, accuracy, correlation)
