"""Quality rules whose cutoffs are chosen with a bound on false rejections.

Per-text statistics feed a few rules (reject when a value exceeds a cutoff).  In
each stratum the labelled documents are split by a hash of doc_id into a tuning
and a testing half.  The tuning half's good documents give each rule a ladder of
cutoffs from loose to strict, by quantiles that share the allowed loss among
the rules.  On the testing half the ladder is walked from its loosest step as
long as the exact binomial (Clopper-Pearson) upper bound of the share of good
documents that any rule rejects stays within ALPHA; within a stratum the walk
needs no further correction (fixed sequence), over strata the error level is
divided by their number (Bonferroni).  So with probability 1 - DELTA at least,
no stratum loses more than ALPHA of its good documents to the rules.  A stratum
with too few labels to show that keeps all that the base rules keep.

Edge cases: null texts count as empty, and empty texts fail the base rules;
labels that are null, or name no document, teach nothing, and a doc_id labelled
more than once is good if any label says so; rows with a null doc_id are judged
like any other; a null stratum is a stratum of its own; tables without rows give
none; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table
from .words import row_sums, slices

ALPHA, DELTA = 0.01, 0.05
#: The steps of the ladder: shares of ALPHA that the rules together may take on the tuning half.
LADDER = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SYMBOLS = b"#*$%&|<>"
#: name -> value of a rule, over the columns of ``statistics``
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "cries": "n_cries / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "- word_chars / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_cries")


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in some 3-word window found twice or more among these words."""
    n = len(codes)
    if n < 4:
        return 0
    if distinct < 1 << 21:
        key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:  # number the pairs first
        pair = np.unique((codes[:-1] << 31) | codes[1:], return_inverse=True)[1].astype(np.int64)
        key = (pair[:-1] << 31) | codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


_BLANK = " \t\n\r\x0b\x0c"


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    out: dict[str, list] = {c: [] for c in COLUMNS}
    is_of = lambda chars: np.isin(np.arange(256), list(chars)).astype(np.int32)
    symbols, capitals, cries = is_of(SYMBOLS), is_of(range(65, 91)), is_of(b"!?")
    # code points in words: bytes that neither continue a character nor are white space
    heads = 1 - is_of([*range(128, 192), 32, *range(9, 14)])
    for t in slices(column):
        out["n_words"].append(np.diff(t.bounds))
        for name, kind in (("word_chars", heads), ("n_symbols", symbols), ("n_capitals", capitals), ("n_cries", cries)):
            out[name].append(row_sums(kind[t.raw].astype(np.int64), t.starts).astype(np.int64))
        bounds, vocab = t.bounds.tolist(), len(t.vocab)
        out["n_repeat_words"].append(np.array([repeated_words(t.codes[a:b], vocab) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.int64))
        lines = [duplicate_lines(x) for x in t.array.to_pylist()]
        out["n_lines"].append(np.array([x[0] for x in lines], dtype=np.int64))
        out["n_dup_lines"].append(np.array([x[1] for x in lines], dtype=np.int64))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, the COLUMNS) of every document."""
    small_batches(docs.sparkSession)

    def each(batches):
        for batch in batches:
            got = measure(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[c]) for c in COLUMNS)], ["doc_id", "stratum", *COLUMNS])

    kinds = ", ".join(f"{c} long" for c in COLUMNS)
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    return rows.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stratum string, {kinds}")


def tail_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial."""
    if p <= 0 or k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a share of which k of n were seen."""
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail_at_most(k, n, mid) > delta else (lo, mid)
    return hi


def choose(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step, bound, cut_<rule>...) for strata where some step of the ladder is shown to be safe."""
    spark = stats.sparkSession
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    rules = [F.expr(v).alias(r) for r, v in RULES.items()]
    seen = stats.join(good, "doc_id").where(f"not ({BASE_FAILED})").select("stratum", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0).alias("tune"), *rules)
    shares = [1 - alpha * s / len(RULES) for s in LADDER]
    cuts = seen.where("tune").groupBy("stratum").agg(*(F.percentile_approx(r, F.lit(shares), F.lit(100_000)).alias(f"q_{r}") for r in RULES))
    steps = cuts.select("stratum", F.explode(F.sequence(F.lit(0), F.lit(len(LADDER) - 1))).alias("step"), *(F.col(f"q_{r}") for r in RULES))
    steps = steps.select("stratum", "step", *(F.element_at(f"q_{r}", F.col("step") + 1).alias(f"cut_{r}") for r in RULES))
    steps = steps.toArrow().to_pylist()  # strata * ladder
    if not steps:
        return spark.createDataFrame([], _cuts_schema())
    ladder = spark.createDataFrame([tuple(s.values()) for s in steps], "stratum string, step int, " + ", ".join(f"cut_{r} double" for r in RULES))
    hit = F.expr(" or ".join(f"{r} > cut_{r}" for r in RULES))
    test = seen.where("not tune").alias("s").join(F.broadcast(ladder).alias("l"), F.expr("s.stratum <=> l.stratum"))
    counts = test.groupBy(F.col("l.stratum").alias("stratum"), "step").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("k")).toArrow().to_pylist()
    strata = {s["stratum"] for s in steps}
    chosen = []
    for stratum in strata:
        best = None
        for c in sorted((c for c in counts if c["stratum"] == stratum), key=lambda c: c["step"]):
            bound = upper_bound(c["k"], c["n"], delta / len(strata))
            if bound > alpha:
                break
            best = (c["step"], bound)
        if best:
            cut = next(s for s in steps if s["stratum"] == stratum and s["step"] == best[0])
            chosen.append((stratum, best[0], best[1], *(cut[f"cut_{r}"] for r in RULES)))
    return spark.createDataFrame(chosen, _cuts_schema())


def _cuts_schema() -> str:
    return "stratum string, step int, bound double, " + ", ".join(f"cut_{r} double" for r in RULES)


def judge(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats with base_failed and kept; cuts has a row for each stratum at most."""
    hit = F.expr(" or ".join(f"({v}) > cut_{r}" for r, v in RULES.items()))
    rows = stats.alias("s").join(F.broadcast(cuts).alias("c"), F.expr("s.stratum <=> c.stratum"), "left")
    base = F.expr(BASE_FAILED)
    return rows.select("s.*", base.alias("base_failed"), (~base & ~F.coalesce(hit, F.lit(False))).alias("kept"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(statistics(table(spark, sf_dir, "documents")), "statistics")
    out = judge(stats, choose(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
