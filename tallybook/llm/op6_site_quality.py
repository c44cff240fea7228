"""Quality classifier: document evidence with hierarchical empirical Bayes over sites.

Every document gets a log likelihood ratio from binned features (their bins
are counted by label over all labelled rows). Its posterior under the global
prior then feeds two grouped aggregations: hosts shrink towards the global
rate, paths within a host towards the host. How hard each level shrinks is
estimated from the spread between groups (method of moments), so sparse sites
stay near the prior. A document's own posterior is left out of its site's.

The final log odds are the document's evidence plus its site's log odds.

Defined results: without labels every document has the prior; null text counts
as empty; null host or path is a group of its own; labels for unknown ids do
nothing, and several labels for an id count each; other columns pass through
whatever their names (they travel in one struct), and an input column named like
a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.runtime import durable, small_side, without

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SYMBOLS = "#*$%&|<>"
FEATURES = ["upper", "digits", "symbols", "bangs", "repeats", "word_length", "dup_lines", "size"]
CLIP = 6.0
MADE = ["evidence", "site_rate", "score", "kept"]


def _bits(x: Column) -> Column:
    return F.length(F.bin(F.greatest(x, F.lit(0)).cast("long")))


def with_features(docs: DataFrame, text_col: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """(own: the columns of docs, _key, _host, _path, and one small integer bin (0 to 40) for each feature, as f_<name>)."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    own = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"), *[docs[f"`{c}`"].alias(n) for c, n in ((key, "_key"), (host, "_host"), (path, "_path"))]]
    step = docs.select(*own, text.alias("_t"), F.split(trimmed, "[\\x20\\x09-\\x0D]+").alias("_w"), F.split(text, "\n").alias("_l"))
    size = F.greatest(F.length("_t"), F.lit(1)).cast("long")
    share = lambda chars: F.expr(f"(length(_t) - length(translate(_t, '{chars}', ''))) * 1000L").cast("long") / size
    words = F.greatest(F.size("_w"), F.lit(1))
    bins = {
        "upper": _bits(share(UPPER)),
        "digits": _bits(share(DIGITS)),
        "symbols": F.when(F.col("_t").rlike("[#*$%&|<>]"), _bits(share(SYMBOLS))).otherwise(F.lit(1)),
        "bangs": _bits((F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))) * 1000 / size),
        "repeats": _bits((F.size("_w") - F.size(F.array_distinct("_w"))) * 1000 / words),
        "word_length": F.least(F.lit(40), (F.length("_t") / words).cast("int")),
        "dup_lines": _bits((F.size("_l") - F.size(F.array_distinct("_l"))) * 1000 / F.size("_l")),
        "size": _bits(words),
    }
    return step.select("own", "_key", "_host", "_path", *[bins[n].cast("int").alias(f"f_{n}") for n in FEATURES])


def train_evidence(features: DataFrame, labels: DataFrame, label_col: str = "quality", key: str = "doc_id") -> tuple[float, dict]:
    """Prior rate and, for each feature and bin, the log likelihood ratio; the table has at most 8 x 41 cells."""
    truth = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(key).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    rows = features.join(truth, features["_key"] == truth["_id"])
    cells = rows.select("_y", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"f_{n}").alias("bin")) for n in FEATURES])))
    counts = cells.groupBy("feature", "bin").agg(F.sum("_y").alias("good"), F.count("*").alias("n")).collect()
    good = sum(c.good for c in counts) / len(FEATURES)
    bad = sum(c.n for c in counts) / len(FEATURES) - good
    table: dict = {}
    for c in counts:
        table[(c.feature, c.bin)] = max(-CLIP, min(CLIP, math.log((c.good + 1) / (good + 20)) - math.log((c.n - c.good + 1) / (bad + 20))))
    return (good + 1) / (good + bad + 2), table


def _evidence(table: dict) -> Column:
    parts = []
    for n in FEATURES:
        cells = [F.lit(x) for (f, b), v in sorted(table.items()) if f == n for x in (int(b), float(v))]
        parts.append(F.coalesce(F.element_at(F.create_map(*cells), F.col(f"f_{n}")), F.lit(0.0)) if cells else F.lit(0.0))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, centre: Column, n: str, s: str) -> float:
    """Prior weight, in documents, from the spread of group means about their parents (method of moments)."""
    mean = F.col(s) / F.col(n)
    row = groups.filter(F.col(n) > 1).agg(F.sum(F.col(n) * (mean - centre) * (mean - centre)).alias("between"), F.sum(centre * (1 - centre)).alias("noise"), F.sum(n).alias("n"), F.sum(F.col(n) * centre * (1 - centre)).alias("within")).first()
    if not row or not row.n:
        return 10.0
    spread = max(1e-9, (row.between - row.noise) / row.n)
    return min(1000.0, max(2.0, row.within / row.n / spread - 1))


def site_rates(scored: DataFrame, prior: float) -> tuple[DataFrame, float]:
    """(_host, _path, n, s, host's shrunken rate) and the strength of a host's rate for its paths."""
    paths = durable(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.round(F.sum("_p"), 6).alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    k1 = _strength(hosts, F.lit(prior), "hn", "hs")
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("hs") + k1 * prior) / (F.col("hn") + k1)).alias("host_rate"))
    paths = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"])).drop("_h")
    return paths, _strength(paths, F.col("host_rate"), "n", "s")


def score_features(features: DataFrame, slim: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """features with evidence, site_rate, score (posterior of good quality) and kept.

    slim: the same rows without the texts, kept in the shared folder, for the aggregates.
    """
    prior, table = train_evidence(slim, labels)
    own = lambda e: 1 / (1 + F.exp(-(e + F.lit(math.log(prior / (1 - prior))))))
    paths, k2 = site_rates(slim.withColumn("_p", own(_evidence(table))), prior)
    scored = features.withColumn("evidence", _evidence(table))
    sites = small_side(paths.withColumnsRenamed({"_host": "_h", "_path": "_p"}))
    joined = scored.join(sites, scored["_host"].eqNullSafe(sites["_h"]) & scored["_path"].eqNullSafe(sites["_p"]), "left")
    rate = (F.col("s") - own(F.col("evidence")) + k2 * F.col("host_rate")) / (F.col("n") - 1 + k2)
    joined = joined.withColumn("site_rate", F.greatest(F.lit(1e-6), rate))
    score = F.round(1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site_rate"))))), 6)
    return joined.withColumn("score", score).withColumn("kept", score >= threshold)


def _slim(features: DataFrame) -> DataFrame:
    return durable(features.select("_key", "_host", "_path", *[f"f_{n}" for n in FEATURES]))


def site_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.3) -> DataFrame:
    """docs with evidence, site_rate, score and kept; the texts are read once for the aggregates, once for the rows."""
    docs = without(docs, MADE)
    features = with_features(docs, text_col, host=host, path=path)
    return score_features(features, _slim(features), labels, threshold).select("own.*", *MADE)


def op6_site_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    slim = _slim(with_features(docs))
    rounded = [F.round(c, 6).alias(c) for c in ("evidence", "site_rate")]
    return score_features(slim, slim, labels).select(F.col("_key").alias("doc_id"), F.col("_host").alias("source"), F.col("_path").alias("lang"), *rounded, "score", "kept")
