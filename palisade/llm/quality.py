"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on text statistics gives each document evidence, a calibrated log-likelihood
ratio of good against bad. Sites have a prior of their own: grouped aggregation counts good
documents by path and host (labels where given, the classifier's posterior elsewhere), and
Beta priors shrink a path's rate toward its host's and a host's toward the global rate, the
more the fewer documents it has. Prior strengths come from the spread between the groups.

The model is fitted on at most MAX_LABELLED labelled documents; rates cover all documents."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import logistic
from palisade.llm.common import bounded_sample, text_sha, written

MAX_LABELLED = 20_000
KEEP = 0.5
FEATURES = 14
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_LOWER_OR_HIGH = bytes(b for b in range(256) if 97 <= b <= 122 or b >= 128)
_PUNCT = b".,;:'\"?()-"
_OTHER = bytes(b for b in range(33, 127) if b not in _UPPER + _DIGITS + _PUNCT and not 97 <= b <= 122)


def statistics(text: str) -> list:
    """Shares and lengths of characters, words and lines; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    n, w = len(raw), len(words)
    count = lambda drop: n - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, count(_UPPER) + count(_LOWER_OR_HIGH))
    return [
        math.log1p(w), count(_UPPER) / letters, count(_DIGITS) / n, count(_PUNCT) / n, count(_OTHER) / n, count(_OTHER) / w,
        raw.count(b"!") / w, raw.count(b"|") / w, letters / w, len(set(words)) / w, len(set(words)) / math.sqrt(w),
        len(set(lines)) / len(lines), math.log1p(w / len(lines)), raw.count(b".") / w,
    ]


def _features(batches):
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.drop_columns(["text"]).schema.names, "x"])


class Logistic:
    """Ridge logistic regression on standardised statistics and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        a = self._design(x)
        self.w = logistic.fit(a, y, np.full(a.shape[1], ridge), np.zeros(a.shape[1]))
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.0

    def _design(self, x):
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, z * z], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w

    def calibrate(self, x: np.ndarray, y: np.ndarray):
        """Platt scaling; `evidence` is the calibrated logit without the sample's prior."""
        self.scale, self.shift = logistic.platt(self.logits(x), y > 0)
        n1, n0 = y.sum(), (1 - y).sum()
        self.prior = math.log((n1 + 1) / (n0 + 1))
        return self

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.logits(x) * self.scale + self.shift - self.prior, -30, 30)


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, least: int = 20):
    """A calibrated model, or None with fewer than `least` documents of either class.

    labelled: doc_id, x, y. The sample is chosen by the hash of the id, a quarter of it held out
    for calibration."""
    rows = bounded_sample(labelled, F.xxhash64("doc_id"), max_labelled)
    y = np.array([r["y"] for r in rows], float)
    if y.sum() < least or (1 - y).sum() < least:
        return None
    x = np.array([r["x"] for r in rows])
    held = np.array([r["_h"] % 4 == 0 for r in rows])
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.arange(len(rows)) % 4 == 0
    return Logistic(x[~held], y[~held]).calibrate(x[held], y[held])


def _evidence(model):
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            rows = np.array(x.to_pylist(), float).reshape(len(x), FEATURES)
            e = model.evidence(rows) if model is not None else np.zeros(len(x))
            rest = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(e, pa.float64())], [*rest.schema.names, "evidence"])

    return run


def _strength(groups: DataFrame, parent: Column) -> float:
    """Strength of the Beta prior by the method of moments: the spread of the group rates k / n
    around their parents, beyond binomial noise."""
    rate = F.col("k") / F.col("n")
    r = groups.agg(
        F.avg(parent).alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * (rate - parent) * (rate - parent)).alias("spread"),
        F.sum(parent * (1 - parent)).alias("noise"),
    ).first()
    if not r["n"]:
        return 1.0
    between = max((r["spread"] - r["noise"]) / r["n"], 1e-4)
    return min(max(r["m"] * (1 - r["m"]) / between - 1, 1.0), 10_000.0)


def shrunk_sites(counted: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate from host, path, n, k (documents and good ones)."""
    total = counted.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = ((total["k"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)
    hosts = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("k") + s * overall) / (F.col("n") + s)).alias("host_rate"))
    paths = counted.join(hosts, "host")
    s = _strength(paths, F.col("host_rate"))
    return paths.select("host", "path", "host_rate", ((F.col("k") + s * F.col("host_rate")) / (F.col("n") + s)).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: float = KEEP, max_labelled: int = MAX_LABELLED, sha: bool = False) -> DataFrame:
    """One row per input row: doc_id, evidence, host_rate, path_rate, score (probability of a
    good document), kept (score >= keep), with `sha` also the SHA-256 of the text.

    Null hosts and paths are a site of their own. Null texts count as empty, their statistics as
    zeros. Of repeated labels the smallest counts, null labels count as none. Without enough
    labels of both classes the evidence is 0 and every document is kept."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("_id")).agg(F.min(F.col(label).cast("double")).alias("y"))
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("\0")).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *([text_sha(F.col(text)).alias("sha")] if sha else []),
    )
    more = ["sha"] if sha else []
    key = "doc_id long, host string, path string" + ", sha binary" * sha
    stats = written(base.mapInArrow(_features, f"{key}, x array<double>"), "quality-statistics")
    model = fit(stats.join(known, stats["doc_id"] == known["_id"]).select("doc_id", "x", "y"), max_labelled)
    seen = stats.mapInArrow(_evidence(model), f"{key}, evidence double")
    seen = written(seen.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "quality-evidence")
    prior = F.lit(model.prior if model is not None else 30.0)
    soft = F.coalesce(F.col("y"), 1 / (1 + F.exp(-(F.col("evidence") + prior))))
    counted = written(seen.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(soft).alias("k")), "quality-sites")
    sites = written(shrunk_sites(counted), "quality-rates")
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    scored = seen.join(sites, ["host", "path"], "left").withColumn("score", score)
    kept = F.lit(True) if model is None else F.coalesce(F.col("score") >= keep, F.lit(True))
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", "score", kept.alias("kept"), *more)
