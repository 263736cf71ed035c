"""Mixing sources to target weights by Poisson replication.

Each document draws one hash-seeded uniform number u from its id. Its number of copies is the
inverse, at u, of a Poisson distribution cut off at the source's ``max_repeats``; the mean is
chosen per source so that the source holds its target share of the mix. The mix is as large as the
scarcest source allows at its cap (that source is used ``max_repeats`` times throughout). The
means are calibrated on the draw that was really made: the tokens of each source are summed by
bucket of u (``BUCKETS`` per source, so what the driver reads is bounded by the target table), and
the Poisson mean is found by bisection on these sums. The copies are exploded and put into a
global order by a hash of (seed, document, copy).

Defined results: labels are compared without letter case, outer blanks, and with blanks and hyphens
as underscores; documents of other or null labels, and those without a token, take no part; a
target label without documents gets no copies, and the other shares are scaled up to sum to 1;
repeated rows of one doc_id draw alike; empty tables give an empty mix; extra columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.tokenizer import count_tokens
from clausewright.session import cut_lineage

BUCKETS = 4096
MAX_TARGETS = 10_000


def source_label(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s\x{00A0}]+", " "))), r"[ \-]+", "_")


def cut_poisson(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k below ``cap``: the thresholds that u must reach for k + 1 copies."""
    if math.isinf(mean):
        return [0.0] * cap
    out, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        out.append(min(1.0, total))
    return out


def drawn_size(sums: dict[int, int], thresholds: list[float]) -> float:
    """Tokens used when a document takes one copy per threshold that its u reaches; a bucket is split evenly."""
    return sum(size * sum(min(1.0, max(0.0, b + 1 - t * BUCKETS)) for t in thresholds) for b, size in sums.items())


def fitted_mean(sums: dict[int, int], target: float, cap: int) -> float:
    if target >= cap * sum(sums.values()) * (1 - 1e-12):
        return math.inf
    low, high = 0.0, 1.0
    while drawn_size(sums, cut_poisson(high, cap)) < target and high < 1e6:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if drawn_size(sums, cut_poisson(middle, cap)) < target else (low, middle)
    return high


def sized_documents(documents: DataFrame, mix_targets: DataFrame, seed: int, vocabulary: str | None) -> DataFrame:
    """Documents of target labels with label, n_tokens and u."""
    labels = [r[0] for r in mix_targets.select("source_label").filter(F.col("source_label").isNotNull()).distinct().limit(MAX_TARGETS + 1).collect()]
    if len(labels) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target labels")
    own = documents.select("doc_id", "text", source_label(F.col("source")).alias("source_label")).filter(F.col("source_label").isin(labels) & F.col("text").isNotNull())
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(2**53))
    # tokens are counted once; the plan and the replication both read the checkpoint
    return cut_lineage(count_tokens(own, vocabulary).filter("n_tokens > 0").withColumn("u", u))


def target_rows(mix_targets: DataFrame) -> DataFrame:
    """One row per label; repeated labels keep the largest share."""
    rows = mix_targets.filter(F.col("source_label").isNotNull()).groupBy("source_label").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    return rows.select("source_label", "t.target_share", "t.max_repeats")


def copy_plan(sized: DataFrame, mix_targets: DataFrame) -> list[dict]:
    """Per target label: share, cap, documents, size, Poisson mean and thresholds."""
    targets = {r["source_label"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in target_rows(mix_targets).collect()}
    rows = sized.groupBy("source_label", F.floor(F.col("u") * BUCKETS).alias("bucket")).agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n")).collect()
    sums: dict[str, dict[int, int]] = {}
    docs: dict[str, int] = {}
    for r in rows:
        sums.setdefault(r["source_label"], {})[r["bucket"]] = r["size"]
        docs[r["source_label"]] = docs.get(r["source_label"], 0) + r["n"]
    present = {s: t for s, t in targets.items() if s in sums and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in present.values())
    total = min((cap * sum(sums[s].values()) / (share / whole) for s, (share, cap) in present.items()), default=0.0)
    plan = []
    for label, (share, cap) in sorted(targets.items()):
        size = sum(sums.get(label, {}).values())
        mean = fitted_mean(sums[label], total * share / whole, cap) if label in present else 0.0
        plan.append({"label": label, "share": share, "cap": cap, "docs": docs.get(label, 0), "size": size, "mean": mean, "thresholds": cut_poisson(mean, cap) if label in present else []})
    return plan


def replicate(sized: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    """One row per copy, in a global random order: (position key, doc_id, copy_no, source_label, n_tokens, text)."""
    copies = F.lit(0)
    for p in plan:
        reached = sum((F.when(F.col("u") >= t, 1).otherwise(0) for t in p["thresholds"]), F.lit(0))
        copies = F.when(F.col("source_label") == p["label"], reached).otherwise(copies)
    out = sized.withColumn("__n", copies).filter("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no").alias("order_key"), "doc_id", "copy_no", "source_label", "n_tokens", "text").orderBy("order_key", "doc_id", "copy_no")


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    sized = sized_documents(documents, mix_targets, seed, vocabulary)
    return replicate(sized, copy_plan(sized, mix_targets), seed)


def reached_shares(documents: DataFrame, mix_targets: DataFrame, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """Per target label: documents, tokens, tokens used, target and reached share, most copies of a document."""
    sized = sized_documents(documents, mix_targets, seed, vocabulary)
    used = replicate(sized, copy_plan(sized, mix_targets), seed).groupBy("source_label").agg(
        F.sum("n_tokens").alias("used_tokens"), F.max("copy_no").alias("most_repeats"), F.count_distinct("doc_id").alias("used_documents"))
    whole = used.agg(F.sum("used_tokens").alias("__whole"))
    return target_rows(mix_targets).join(used, "source_label", "left").join(F.broadcast(whole)).select(
        "source_label", "target_share", "max_repeats", F.coalesce("used_documents", F.lit(0)).alias("used_documents"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("used_tokens") / F.col("__whole"), F.lit(0.0)).alias("reached_share"))
