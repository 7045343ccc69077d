"""Operator 2: quality rules with robust multivariate outliers.

Fixed rules fail a document first. The rest have a vector of transformed statistics; for
each language and source the minimum-covariance-determinant estimate is found by
concentration steps, and documents at too great a Mahalanobis distance are rejected.

A concentration step keeps the share H of a group's documents nearest to the present centre
and takes their mean and covariance; each step is two aggregations with map-side partial
results over the statistics of all documents, so neither hot groups nor many groups gather rows. There are
three starts, all around the coordinatewise median: the MADs alone, and with them the spatial signs' or
the hyperbolic tangents' second moments. Each takes steps until the determinant falls no more; the smallest determinant
is kept. The covariance has the usual consistency factor and a floor on its diagonal (many clean documents share a zero in
some statistics), and one reweighting step ends it.

Groups of fewer than LEAST documents, five for each statistic, have too few for an estimate of their own: they are pooled within their
language, and languages that still have fewer are pooled together. That last pool is judged whatever its size.

Defined cases: null, empty and blank texts have zero words and fail the base rules. A null
language or source is a value of its own. Lines are those of splitting at \\n; a line counts as a
duplicate if it has a word and an earlier line of the same document equals it. Repeated rows each count and
are each returned; null ids too. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.llm.common import WHITE, map_arrow, saved, table

#: Parameters: least documents in a group, share kept by a concentration step, the fall of the determinant's logarithm
#: below which a start has settled, and the tail probabilities of reweighting and rejection.
LEAST, H, SETTLED, REWEIGHT, REJECT = 35, 0.5, 0.01, 0.025, 1e-4
#: The statistics of the vector and the least standard deviation taken for each.
FEATURES = {"log_words": 0.6, "word_length": 0.5, "symbol_share": 0.06, "dup_line_share": 0.12, "repeat_share": 0.12, "upper_share": 0.1, "digit_share": 0.06}
P = len(FEATURES)
SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=n)
    _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
    window = pair[:-1] * len(number) + w[2:]  # below 2**63: both factors are below the number of words
    _, back, count = np.unique(window, return_inverse=True, return_counts=True)
    often = count[back] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = full = 0
    for line in lines:
        if line and not line.isspace():
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeat_words(words)
    upper, digit = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _DIGIT))
    one = max(n, 1)
    vector = (math.log1p(n), chars / one, math.sqrt(symbols / max(chars, 1)), math.sqrt(dup / max(full, 1)), math.sqrt(repeat / one), math.sqrt(upper / max(chars, 1)), math.sqrt(digit / max(chars, 1)))
    return (n, chars, symbols, dup, repeat, *vector)


def chi2_cdf(x: float, p: int) -> float:
    """Lower regularised gamma function by its series."""
    a, t = p / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 2000):
        term *= t / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-t + a * math.log(t) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the innermost share of a normal sample is multiplied with."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def distance(group_mean: str = "mean", inverse: str = "inv") -> Column:
    """Squared Mahalanobis distance of x0..x6 from arrays of the group."""
    d = [F.col(f"x{i}") - F.col(group_mean)[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1.0 if i == j else 2.0) * F.col(inverse)[i * P + j] * d[i] * d[j]
    return total


def with_group(rows: DataFrame, groups: DataFrame, most: int = 200_000) -> DataFrame:
    """Joins the groups' numbers to the rows; they are broadcast only if they are few."""
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, "cell")


def estimates(inner: DataFrame, share: float) -> DataFrame:
    """cell, start, mean, inverse covariance and its determinant's logarithm of the rows given (x0..x6, cell, start)."""
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    cross = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(P) for j in range(i, P)]
    moments = inner.groupBy("cell", "start").agg(*mean, *cross)
    moments = moments.select("cell", "start", F.array(*[f"m{i}" for i in range(P)]).alias("mean"), F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in range(P) for j in range(P)]).alias("cov"))
    factor, floor = consistency(share), np.diag(np.square(list(FEATURES.values())))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, covs = batch.column(2), batch.column(3).to_pylist()
            inv, det = [], []
            for c in covs:
                # The floor is added as a prior: it keeps the matrix well conditioned and never shrinks a spread.
                full = np.array(c).reshape(P, P) * factor + floor
                inv.append(np.linalg.inv(full).ravel().tolist())
                det.append(np.linalg.slogdet(full)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), means, pa.array(inv, pa.list_(pa.float64())), pa.array(det, pa.float64())], names=["cell", "start", "mean", "inv", "det"])

    return saved(map_arrow(moments, invert, "cell string, start int, mean array<double>, inv array<double>, det double"))


def starts(passed: DataFrame) -> DataFrame:
    """cell, start, mean and inv of each start of each group: MADs, spatial signs, hyperbolic tangents."""
    middle = saved(passed.groupBy("cell").agg(F.array(*[F.percentile_approx(f"x{k}", 0.5, 1000) for k in range(P)]).alias("mean")))
    off = with_group(passed, middle)
    mads = [F.percentile_approx(F.abs(F.col(f"x{k}") - F.col("mean")[k]), 0.5, 1000) for k in range(P)]
    least = [F.greatest(1.4826 * m, F.lit(v)) for m, v in zip(mads, FEATURES.values(), strict=True)]
    spread = saved(off.groupBy("cell").agg(F.first("mean").alias("mean"), F.array(*least).alias("scale")))
    z = with_group(passed, spread).select("cell", "mean", "scale", *[((F.col(f"x{k}") - F.col("mean")[k]) / F.col("scale")[k]).alias(f"z{k}") for k in range(P)])
    square = sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(P)), F.lit(0.0))
    z = z.withColumn("square", F.greatest(square, F.lit(1e-24)))
    pairs = [(min(i, j), max(i, j)) for i in range(P) for j in range(P)]
    own = sorted(set(pairs))
    signs = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("square")).alias(f"u{i}_{j}") for i, j in own]
    bends = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in own]
    found = z.groupBy("cell").agg(F.first("mean").alias("mean"), F.first("scale").alias("scale"), *signs, *bends)
    found = found.select("cell", "mean", "scale", *[F.array(*[f"{c}{i}_{j}" for i, j in pairs]).alias(c) for c in "ut"])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"cell": [], "start": [], "mean": [], "inv": []}
            for cell, mean, scale, *shapes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, shape in enumerate([np.eye(P), *(np.array(c).reshape(P, P) + 0.01 * np.eye(P) for c in shapes)]):
                    out["cell"].append(cell)
                    out["start"].append(k)
                    out["mean"].append(mean)
                    out["inv"].append(np.linalg.inv(shape * np.outer(scale, scale)).ravel().tolist())
            yield pa.RecordBatch.from_pydict({"cell": pa.array(out["cell"], pa.string()), "start": pa.array(out["start"], pa.int32()), **{c: pa.array(out[c], pa.list_(pa.float64())) for c in ("mean", "inv")}})

    return saved(map_arrow(found, invert, "cell string, start int, mean array<double>, inv array<double>"))


def concentrated(passed: DataFrame) -> DataFrame:
    """cell, mean and inv of the start of smallest determinant, after steps until it has settled."""
    now = starts(passed).withColumn("det", F.lit(float("inf")))
    done = now.limit(0)
    while not now.isEmpty():  # a determinant has the floors' as its least, so every start settles
        far = with_group(passed, now.select("cell", "start", "mean", "inv")).withColumn("d2", distance())
        cut = far.groupBy("cell", "start").agg(F.percentile_approx("d2", H, 1000).alias("cut"))
        cut = saved(now.select("cell", "start", "mean", "inv").join(cut, ["cell", "start"]))
        inner = with_group(passed, cut).where(distance() <= F.col("cut"))
        new = estimates(inner.select("cell", "start", *[f"x{k}" for k in range(P)]), H)
        new = saved(new.join(now.select("cell", "start", F.col("det").alias("before")), ["cell", "start"]).withColumn("over", F.col("before") - F.col("det") < SETTLED))
        over = new.where("over").drop("over", "before")
        done = done.unionByName(over)
        now = new.where(~F.col("over")).drop("over", "before")
    best = done.groupBy("cell").agg(F.min_by(F.struct("mean", "inv"), F.struct("det", "start")).alias("best"))
    return saved(best.select("cell", "best.mean", "best.inv"))


def cells(stats: DataFrame) -> DataFrame:
    """The group of each language and source: lang, source, cell."""
    key = lambda *c: F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c])
    n = saved(stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")))
    own = n.select("lang", "source", "n", F.when(F.col("n") >= LEAST, F.concat(F.lit("s"), key("lang", "source"))).otherwise(F.concat(F.lit("l"), key("lang"))).alias("cell"))
    size = own.groupBy("cell").agg(F.sum("n").alias("size"))
    return own.join(size, "cell").select("lang", "source", F.when(F.col("size") >= LEAST, F.col("cell")).otherwise(F.lit("rest")).alias("cell"))


def judged(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base statistics, base_failed, kept and distance (null where no estimate applies)."""
    texts = docs.select("doc_id", "text", "lang", "source")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"x{k}" for k in range(P)]]
        for batch in batches:
            made = [statistics(t) for t in batch.column(1).to_pylist()]
            kept = [batch.column(0), batch.column(2), batch.column(3)]
            columns = [pa.array([m[k] for m in made], pa.int64() if k < 5 else pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", "lang", "source", *names])

    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"x{k} double" for k in range(P))
    stats = map_arrow(texts.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), measure, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = saved(stats.withColumn("base_failed", failed))
    where = saved(cells(stats))
    side = F.broadcast(where) if where.count() <= 200_000 else where
    w = side.select(F.col("lang").alias("w_lang"), F.col("source").alias("w_source"), "cell")
    placed = stats.join(w, F.col("lang").eqNullSafe(F.col("w_lang")) & F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_lang", "w_source")
    passed = placed.where(~F.col("base_failed") & F.col("cell").isNotNull())
    now = concentrated(passed)
    inner = with_group(passed, now).where(distance() <= chi2_quantile(1 - REWEIGHT, P))
    now = estimates(inner.select("cell", F.lit(0).alias("start"), *[f"x{k}" for k in range(P)]), 1 - REWEIGHT).select("cell", "mean", "inv")
    few = now.count() <= 200_000
    out = placed.join(F.broadcast(now) if few else now, "cell", "left")
    d = F.when(~F.col("base_failed"), F.sqrt(F.greatest(distance(), F.lit(0.0))))
    limit = math.sqrt(chi2_quantile(1 - REJECT, P))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(d <= limit, F.lit(True))).alias("kept"), d.alias("distance"),
    )


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
