"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(text: Column) -> dict[str, Column]:
    """Transformed statistics of a whole text; all 0 for null and empty texts.

    Shares of characters or words p enter as sqrt(p), counts as log1p.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text) + 20  # a few more than there are: shares of short texts vary less
    gaps = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 5
    share = lambda pattern, of: F.sqrt(F.regexp_count(text, F.lit(pattern)) / of)
    return {
        "log_chars": F.log1p(F.length(text)),
        "word_length": F.log1p(F.length(text) / gaps),
        "symbols": share(r"[#*$%&|<>_=~^@{}\[\]\\]", chars),
        "upper": share(r"[A-Z]", chars),
        "punctuation": share(r"[.,;:!?]", chars),
        "digits": share(r"[0-9]", chars),
        "lines": share(r"\n", gaps),
        "odd_words": share(r"[^\x20\x09-\x0D\p{L}\p{N}]{2,}", gaps),
        "lone_marks": share(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}](?![^\x20\x09-\x0D])", gaps),
        "repeats": share(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))", gaps),
    }


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the shrunk covariance and its log-determinant."""

    names: tuple[str, ...]
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]
    scale: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], pooled: float = 0.2, ridge: float = 0.05) -> QuadraticDiscriminant:
        """Class covariance = (1-ridge) * ((1-pooled) * own + pooled * common) + ridge * identity, on standardised columns.

        A class without rows takes the common mean and covariance; priors are smoothed by one row.
        """
        d = x.shape[1]
        centre = x.mean(0) if len(x) else np.zeros(d)
        spread = x.std(0) if len(x) else np.ones(d)
        spread = np.where(spread > 1e-9, spread, 1.0)
        z = (x - centre) / spread
        common = np.cov(z, rowvar=False, bias=True).reshape(d, d) if len(z) else np.zeros((d, d))
        classes = []
        for label in (0, 1):
            own = z[y == label]
            cov = np.cov(own, rowvar=False, bias=True).reshape(d, d) if len(own) > 1 else common
            cov = (1 - ridge) * ((1 - pooled) * cov + pooled * common) + ridge * np.eye(d)
            chol = np.linalg.cholesky(cov)
            mean = own.mean(0) if len(own) else np.zeros(d)
            classes.append((float(np.log((len(own) + 1) / (len(z) + 2))), mean, np.linalg.inv(chol), float(2 * np.log(np.diag(chol)).sum())))
        return QuadraticDiscriminant(names, tuple(classes), (centre, spread))

    def log_density(self, label: int, columns: dict[str, Column]) -> Column:
        """Log prior + Gaussian log density (without the constant both classes share)."""
        prior, mean, inverse, logdet = self.classes[label]
        centre, spread = self.scale
        z = [(columns[n] - F.lit(float(c))) / F.lit(float(s)) - F.lit(float(m)) for n, c, s, m in zip(self.names, centre, spread, mean, strict=True)]
        distance = F.lit(0.0)
        for i in range(len(z)):
            row = F.lit(0.0)
            for j in range(i + 1):
                row = row + F.lit(float(inverse[i, j])) * z[j]
            distance = distance + row * row
        return F.lit(prior - 0.5 * logdet) - 0.5 * distance

    def score(self, columns: dict[str, Column]) -> Column:
        """Posterior of class 1: logistic of the log-density difference."""
        gap = self.log_density(0, columns) - self.log_density(1, columns)
        return 1.0 / (1.0 + F.exp(F.least(F.greatest(gap, F.lit(-700.0)), F.lit(700.0))))


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    most_training_rows: int = 20_000,
    cut: float = 0.3,
    pooled: float = 0.2,
    ridge: float = 0.05,
) -> DataFrame:
    """Score of every row of ``docs``: ``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= ``cut``).

    Learns from the labelled rows whose crc32(key as text) mod ``folds`` is not 0; of
    these at most ``most_training_rows`` label rows, the first by hash of the key (the
    documented bound of the fit).  Labels other than 0 and 1, null labels and null keys
    are not learned from; a row labelled twice counts twice.  The key, language and source are never
    inputs.  Null and empty texts score as a text whose statistics are all 0; without
    any labelled row every score is 0.5.  A null key is not held out.
    """
    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == 0, F.lit(False))
    learn = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y"))
    learn = learn.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~fold("_id"))
    learn = learn.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most_training_rows)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    stats = statistics(F.col("_text"))
    # at most most_training_rows rows of two numbers: small enough for every executor
    sample = rows.join(F.broadcast(learn), F.col("_key") == F.col("_id")).select("_y", *[v.alias(k) for k, v in stats.items()])
    sample = sample.orderBy(*sample.columns).limit(most_training_rows).toPandas()
    model = QuadraticDiscriminant.fit(sample[list(stats)].to_numpy(float).reshape(-1, len(stats)), sample["_y"].to_numpy(int), tuple(stats), pooled, ridge)
    scored = rows.select("_key", *[v.alias(f"_s_{k}") for k, v in stats.items()])
    score = model.score({k: F.col(f"_s_{k}") for k in stats})
    out = scored.select(F.col("_key"), fold("_key").alias("held_out"), score.alias("score"))
    return out.select(F.col("_key").alias(key), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
