"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percepta.llm.labelled import held_out, training_rows
from percepta.shared import freed, packed, written

#: ASCII characters that aren't letters become blanks.
_TABLE = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
#: Letters of the stems that words unknown to the model fall back to.
STEM = 4
#: What cross-fitting on the training rows chooses from: the least log-odds of a toxic token, the standard deviations that it lies
#: above 0 at least, and the tokens that are added to a text's length, as chance segments at its ends are rarer than the law says.
EFFECTS, DEVIATIONS, ENDS = (1.0, 2.0), (2.0, 3.0, 4.0), (0, 100)
#: Rows that are filtered and sent back at once: a copy of a whole batch would double a worker's memory.
SLICE = 500


def tokens(text: str) -> list[str]:
    return text.lower().encode().translate(_TABLE).decode().split()


class _Scores(dict):
    """Log-odds by token. Tokens without any take the stem's, or the neutral score."""

    def __init__(self, known: dict, stems: dict, neutral: float):
        super().__init__(known)
        self.stems, self.neutral, self.room = stems, neutral, 100_000

    def __missing__(self, token: str) -> float:
        score = self.stems.get(token[:STEM], self.neutral) if len(token) > STEM else self.neutral
        if self.room > 0:
            self.room -= 1
            self[token] = score
        return score


def segments(scores: np.ndarray, visits: list | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time after Ruzzo and Tompa.

    Only positive scores can begin or end a segment, so the scan steps over runs of others by prefix sums. Each candidate
    keeps a link to the nearest earlier one with a smaller sum before it; candidates between the two are never looked at
    again, so each is visited a bounded number of times. visits, if given, gets an entry for each visit.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to the end, link
    for i in up.tolist():
        start, end, left, right, link = i, i + 1, float(total[i]), float(total[i + 1]), len(found) - 1
        while link >= 0 and found[link][2] >= left:
            link = found[link][4]
            if visits is not None:
                visits.append(i)
        while link >= 0 and found[link][3] < right:
            # The linked candidate and this one are one segment; its own link is the next to look at.
            start, _, left, _, before = found[link]
            del found[link:]
            link = before
            if visits is not None:
                visits.append(i)
        found.append((start, end, left, right, link))
    return [(s, e, b - a) for s, e, a, b, _ in found]


@dataclass
class ToxicityModel:
    """known and stems: log-odds of tokens and stems; decay, size and ends: the extreme-value law of chance segments; slope and bias: the final logistic."""

    known: dict[str, float]
    stems: dict[str, float]
    neutral: float = -0.1
    decay: float = 1.0
    size: float = 1.0
    ends: int = 0
    weights: list[float] = field(default_factory=lambda: [1.0, 0.0, 0.0])

    def table(self) -> _Scores:
        return _Scores(self.known, self.stems, self.neutral)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[list[float], list[float]]:
        """The surprise -ln P(a chance segment of n tokens scores as high) of each segment."""
        return [self.surprise(n, s) for _, _, s in found]

    def surprise(self, n: int, score: float) -> float:
        expected = self.size * (n + self.ends) * math.exp(-min(self.decay * score, 600.0))
        return -math.log(max(-math.expm1(-expected), 1e-300))

    def features(self, n: int, found: list[tuple[int, int, float]], level: float = 3.0) -> tuple[float, float]:
        each = self.evidence(n, found)
        return min(max(each, default=0.0), 60.0) / 10, math.log1p(sum(x for x in each if x >= level))

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        a, b = self.features(n, found)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def _counted(batches: Iterable) -> Iterator:
    """For each token of a partition the documents that hold it, by label and fold."""
    import pyarrow as pa

    sides = {(y, f): Counter() for y in (1, 0) for f in (0, 1)}
    for batch in batches:
        for text, y, fold in zip(*(batch.column(k).to_pylist() for k in ("text", "y", "fold")), strict=True):
            sides[int(bool(y)), fold].update(set(tokens(text)))
    every = list(set().union(*sides.values()))
    for lo in range(0, len(every), 50_000):
        part = every[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[t] for t in part], pa.int64()) for c in sides.values())], names=["token", "t0", "t1", "c0", "c1"])


def _log_odds(counts: DataFrame, nt: float, nc: float, prior: float) -> dict[str, tuple[float, float]]:
    """Of counts(token, toxic, clean), the log-odds of the tokens that some choice of parameters takes, and how many standard deviations they are.

    The Dirichlet prior is half a document for each token and `prior` documents in proportion to its share of all.
    """
    alpha = F.lit(0.5) + F.lit(prior) * (F.col("toxic") + F.col("clean")) / float(nt + nc)
    a, b = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(a / (nt + prior)) - F.log(b / (nc + prior))
    rows = counts.filter("toxic >= 2").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("far"))
    return {r.token: (r.odds, r.far) for r in rows.filter((F.col("odds") >= min(EFFECTS)) & (F.col("far") > min(DEVIATIONS))).collect()}


def _tables(counts: DataFrame, nt: float, nc: float, prior: float) -> tuple[dict, dict]:
    """Log-odds of tokens, and of stems counted without the tokens that are significant by themselves."""
    known = _log_odds(counts, nt, nc, prior)
    rest = counts.filter(F.length("token") > STEM)
    if known:
        rest = rest.join(F.broadcast(counts.sparkSession.createDataFrame([(t,) for t in known], "token string")), "token", "left_anti")
    stems = rest.groupBy(F.substring("token", 1, STEM).alias("token")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return known, _log_odds(stems, nt, nc, prior)


def _chosen(tables: tuple[dict, dict], effect: float, deviations: float) -> ToxicityModel:
    return ToxicityModel(*({t: odds for t, (odds, far) in some.items() if odds >= effect and far > deviations} for some in tables))


def _calibrated(model: ToxicityModel, found: list[tuple], ends: int) -> float:
    """Fits the law of chance segments and the final logistic to (y, n, scores) of texts; the log loss of the fit."""
    model.ends = ends
    clean = [(n, max(scores, default=0.0)) for y, n, scores in found if not y and n]
    # The law's tail is exponential: the median of the chance scores gives its decay, the share of texts that have none its size.
    tops = np.array([s for _, s in clean if s > 0])
    model.decay = float(np.clip(math.log(2) / np.median(tops), 0.1, 2.0)) if len(tops) else 1.0
    model.size = float((len(tops) + 0.5) / max(sum(n + ends for n, _ in clean), 1))
    x = np.array([(1.0, *model.features(n, [(0, 0, s) for s in scores])) for _, n, scores in found])
    y = np.array([float(y > 0) for y, _, _ in found])
    model.weights = _logistic(x, y)
    for k in (1, 2):  # more evidence never lowers a score
        if model.weights[k] < 0:
            x[:, k] = 0.0
            model.weights = _logistic(x, y)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))), 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, rest: int = 0, most: int = 20_000, prior: float = 1.0) -> ToxicityModel:
    """Fits the model on up to `most` labelled documents that aren't held out (see training_rows); equal texts count once.

    Documents that hold a token are counted by label and fold. The tokens and stems whose log-odds are significant go to the driver,
    at most as many as the sample has words. Each fold is scanned with the other's tokens for every choice of EFFECTS and
    DEVIATIONS; from these scores come the law of chance segments and the final logistic, and the choice with the least log loss
    stays, so parameters see training rows only. With no toxic or no clean labelled document the model knows no token and scores
    by the label there is.
    """
    sample = training_rows(docs, labels, label, parts, rest, most).dropDuplicates(["text"])
    sample = written(sample.select("text", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold")), "toxicity-sample")
    sizes = {(r.y, r.fold): r.n for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y"), "fold").agg(F.count("*").alias("n")).collect()}
    nt, nc = ([sizes.get((y, f), 0) for f in (0, 1)] for y in (1, 0))
    if not sum(nt) or not sum(nc):
        freed(sample)
        return ToxicityModel({}, {}, weights=[6.0 if sum(nt) else -6.0, 0.0, 0.0])
    counts = written(sample.mapInArrow(_counted, "token string, t0 long, t1 long, c0 long, c1 long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")]), "tokens")
    folds = [_tables(counts.select("token", F.col(f"t{f}").alias("toxic"), F.col(f"c{f}").alias("clean")), nt[f], nc[f], prior) for f in (0, 1)]
    choices = [(e, d) for e in EFFECTS for d in DEVIATIONS]
    scans = {}
    for f in (0, 1):
        models = [_chosen(folds[1 - f], *c) for c in choices]
        # At most `most` rows for each choice, of the few segments that each text has.
        for r in sample.filter(F.col("fold") == f).select("text", "y").mapInArrow(_scanned(models), "choice int, y int, n long, scores array<double>").collect():
            scans.setdefault(r.choice, []).append((r.y, r.n, r.scores))
    trials = [(_calibrated(m, scans[i], ends), i, ends, m) for i in sorted(scans) for ends in ENDS for m in [ToxicityModel({}, {})]]
    _, i, ends, law = min(trials, key=lambda t: t[:3])
    both = _tables(counts.select("token", (F.col("t0") + F.col("t1")).alias("toxic"), (F.col("c0") + F.col("c1")).alias("clean")), sum(nt), sum(nc), prior)
    model = _chosen(both, *choices[i])
    model.decay, model.size, model.ends, model.weights = law.decay, law.size, ends, law.weights
    freed(sample, counts)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _found(text: str | None, table: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    own = tokens(text or "")
    return len(own), segments(np.fromiter(map(table.__getitem__, own), float, len(own))) if own else []


def _scanned(models: list[ToxicityModel]):
    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("y").to_pylist()
            for choice, model in enumerate(models):
                table = model.table()  # what it remembers lasts for a batch
                rows = [_found(t, table) for t in texts]
                scores = pa.array([[s for _, _, s in found] for _, found in rows], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([choice] * len(rows), pa.int32()), pa.array(labels, pa.int32()), pa.array([n for n, _ in rows], pa.int64()), scores], names=["choice", "y", "n", "scores"])

    return scan


def _scored(model: ToxicityModel, level: float):
    def score(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            table, out, spans = model.table(), [], []
            for text in batch.column(1):
                n, found = _found(text.as_py(), table)
                out.append(model.score(n, found))
                spans.append([{"start": s, "end": e, "score": v} for s, e, v in found if model.surprise(n, v) >= level])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != 1), pa.array(out, pa.float64()), pa.array(spans, kind)], names=[n for k, n in enumerate(batch.schema.names) if k != 1] + ["score", "passages"])

    return score


def _below(model: ToxicityModel, least: float, at: int):
    """The rows (struct columns) whose field number `at`, the text, scores below least."""

    def keep(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            table = model.table()
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                fine = [model.score(*_found(text.as_py(), table)) < least for text in part.column(0).field(at)]
                yield part.filter(pa.array(fine, pa.bool_()))

    return keep


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, level: float = 3.0) -> DataFrame:
    """doc_id, the columns in keep, score (0 to 1) and passages (token positions and scores of every segment whose surprise is `level` or more).

    Whole texts are scanned, in time linear in their length; null and empty texts score as a text without any segment. Every
    row gets a score of its own, so equal texts, repeated rows and ties score alike; rows and their number stay.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "score", "passages")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("scanned text"), *keep)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_scored(model, level), f"doc_id long{fields}, score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def toxic_apart(docs: DataFrame, model: ToxicityModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that score below `least`, with all their columns, whatever the names. Each row crosses to Python once."""
    rows = packed(docs)
    return rows.mapInArrow(_below(model, least, docs.columns.index(text)), rows.schema).select("row.*")


__all__ = ["ToxicityModel", "fit_toxicity", "held_out", "score_toxicity", "segments", "tokens", "toxic_apart"]
