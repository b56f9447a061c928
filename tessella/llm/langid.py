"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The text's log-likelihood under each language (hashed byte trigrams), the declared markup language and a
prior of the host are added up.  The host's prior is smoothed up a hierarchy: host, domain, address
suffix, all; its counts are sums of the records' own posteriors, by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_column, small_batches

#: Hash buckets of the trigrams; with the number of languages, this bounds the model.
BUCKETS = 1 << 16
#: Languages that a model may have: its table has 2^16 rows of as many numbers, and a scored row as many.
MOST_LANGUAGES = 200
#: Trigrams that a text's evidence counts for at most: neighbours are not independent.
TEXT_WEIGHT = 50.0
#: Probability that a trigram is none of the language's own, but any of all alike.
FOREIGN = 0.1
#: Probability that a declared language is the true one.
TRUST = 0.9
#: Pseudo-counts with which each level of the address leans on the one above.
KAPPA = 5.0
#: A record is accepted from this posterior on.
CONFIDENT = 0.5
#: Hosts with more than this part of all records are joined by broadcast; there can be no more than its inverse.
HOT_PART = 1e-3

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's letters: ASCII lower-cased, all else one space."""
    raw = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Model:
    """Log-probability of each bucket under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.5) -> None:
        self.languages = languages
        p = counts.astype(np.float64) + alpha
        p /= p.sum(axis=0, keepdims=True)
        # what training lacks weighs the same, however much there was to learn from
        self.table = np.log((1 - FOREIGN) * p + FOREIGN / BUCKETS).astype(np.float32)

    def score(self, text: str | None) -> tuple[np.ndarray, int, float]:
        """Weighted log-likelihoods, number of trigrams, best mean log-likelihood of a trigram."""
        g = grams(text)
        if not len(g):
            return np.zeros(len(self.languages)), 0, 0.0
        total = np.zeros(len(self.languages))
        for at in range(0, len(g), 1 << 18):
            total += self.table[g[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        mean = total / len(g)
        return mean * min(float(len(g)), TEXT_WEIGHT), len(g), float(mean.max())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit the trigram table to all labelled rows; rows with a null label or text are left out.

    Every task sums its own counts, so that what is shuffled is one row for each task, language and
    bucket, and what reaches the driver is languages times buckets.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                for name, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    if name not in by:
                        if len(by) >= MOST_LANGUAGES:
                            raise ValueError(f"more than {MOST_LANGUAGES} languages")
                        by[name] = np.zeros(BUCKETS, np.int64)
                    g = grams(t)
                    if len(g) > BUCKETS // 4:
                        by[name] += np.bincount(g, minlength=BUCKETS)
                    else:
                        np.add.at(by[name], g, 1)
        for name, c in by.items():
            k = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(c[k])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted["lang"].to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BUCKETS, max(1, len(names))), np.int64)
    at = {n: i for i, n in enumerate(names)}
    if names:
        counts[counted["bucket"].to_numpy(), [at[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    return Model(names or ["und"], counts)


def html_language(html: Column) -> Column:
    """Primary subtag of the language that markup declares, null where it declares none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def html_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>|&[a-z0-9#]+;", " ")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _softmax(ev: Column) -> Column:
    e = F.transform(ev, lambda x: F.exp(x - F.array_max(ev)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(
    df: DataFrame,
    model: Model,
    text: str = "text",
    host: str | None = None,
    declared: str | None = None,
    keep: list[str] | None = None,
    tag: str = "langid",
) -> DataFrame:
    """Append text_lang, lang_id, lang_posterior and lang_accepted.

    `host` names a column with a host (its last label is the address suffix, its last two the domain),
    `declared` one with the markup's language.  Nulls in either are evidence for nothing.  A text
    without letters (null and empty ones too) has no text evidence and is not accepted; nor is one
    whose posterior is below 0.5 or whose trigrams the model explains worse than chance.  Ties go to the
    language first by name.  Rows that repeat stay; an empty table gives an empty one; very long texts
    are scored whole, in pieces.
    """
    spark = df.sparkSession
    kept = list(df.columns) if keep is None else keep
    fresh(df, "text_lang", "lang_id", "lang_posterior", "lang_accepted")
    names, shared = model.languages, spark.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        m = shared.value

        def run(texts: list[str | None]) -> list[pa.Array]:
            got = [m.score(t) for t in texts]
            return [pa.array([x.tolist() for x, _, _ in got], pa.list_(pa.float64())), pa.array([n for _, n, _ in got], pa.int64()), pa.array([b for _, _, b in got], pa.float64())]

        return run

    h = F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")
    said = F.lower(F.col(declared)) if declared else F.lit(None).cast("string")
    src = df.select(*kept, F.col(text).alias("__text"), h.alias("__host"), said.alias("__said"))
    fields = [T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__n", T.LongType()), T.StructField("__best", T.DoubleType())]
    rows = map_column(src, "__text", fields, make, carry=[*kept, "__host", "__said"])
    langs = F.array(*map(F.lit, names))
    other = (1 - TRUST) / max(1, len(names) - 1)
    # a declaration of a language that the model does not have says nothing
    says = F.when(F.array_contains(langs, F.col("__said")), F.transform(langs, lambda x: F.when(x == F.col("__said"), F.lit(float(np.log(TRUST)))).otherwise(F.lit(float(np.log(other))) if other > 0 else F.lit(0.0))))
    none = F.array(*(F.lit(0.0) for _ in names))
    rows = rows.withColumn("__ev", F.zip_with("__ll", F.coalesce(says, none), lambda a, b: a + b)).drop("__said")
    rows = cut(spark, rows, f"{tag}-scored")  # votes and results read the scores, no text is scored twice
    # levels of the address, by grouped aggregation from the finest upwards
    dotted = F.instr("__host", ".") > 0
    votes = rows.select("__host", _softmax(F.col("__ev")).alias("p"), (F.col("__n") > 0).alias("has")).filter("has")
    cols = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(len(names))]
    by_host = votes.groupBy("__host").agg(*cols, F.count(F.lit(1)).alias("n"))
    by_host = by_host.withColumn("suffix", F.when(dotted, F.substring_index("__host", ".", -1)).otherwise("")).withColumn("domain", F.when(dotted, F.substring_index("__host", ".", -2)).otherwise(""))
    by_host = cut(spark, by_host, f"{tag}-hosts")
    again = [F.sum(f"p{i}").alias(f"p{i}") for i in range(len(names))] + [F.sum("n").alias("n")]
    by_domain = by_host.groupBy("suffix", "domain").agg(*again)
    by_suffix = by_domain.groupBy("suffix").agg(*again)
    total = by_suffix.agg(*again).first()
    n_all = float(total["n"] or 0)
    top = [((total[f"p{i}"] or 0.0) + 1.0) / (n_all + len(names)) for i in range(len(names))]

    def smoothed(level: DataFrame, above: list[Column]) -> list[Column]:
        return [((F.col(f"p{i}") + KAPPA * above[i]) / (F.col("n") + KAPPA)).alias(f"q{i}") for i in range(len(names))]

    qs = by_suffix.select("suffix", *smoothed(by_suffix, [F.lit(x) for x in top]))
    qd = by_domain.join(qs, "suffix").select("suffix", "domain", *smoothed(by_domain, [F.col(f"q{i}") for i in range(len(names))]))
    qh = by_host.join(qd, ["suffix", "domain"]).select("__host", "n", F.array(*smoothed(by_host, [F.col(f"q{i}") for i in range(len(names))])).alias("__prior"))
    qh = cut(spark, qh, f"{tag}-priors")
    # a host with a thousandth of all records goes out by broadcast: there are a thousand at most
    hot = qh.filter(F.col("n") > HOT_PART * n_all).select("__host", F.col("__prior").alias("__hot"))
    cold = qh.filter(F.col("n") <= HOT_PART * n_all).select("__host", "__prior")
    near = rows.join(F.broadcast(hot), "__host", "left")
    if cold.take(1):
        known = near.filter("__hot is not null").withColumn("__prior", F.col("__hot"))
        rest = near.filter("__hot is null").join(cold, "__host", "left")
        rows = known.unionByName(rest)
    else:
        rows = near.withColumn("__prior", F.col("__hot"))
    prior = F.coalesce(F.col("__prior"), F.array(*map(F.lit, top)))
    post = _softmax(F.zip_with("__ev", prior, lambda a, b: a + F.log(b)))
    rows = rows.withColumn("__post", post)
    best = F.array_max("__post")
    name_of = lambda of: F.element_at(langs, F.array_position(of, F.array_max(of)).cast("int"))
    enough = (F.col("__n") > 0) & (best >= CONFIDENT) & (F.col("__best") > float(np.log(1 / BUCKETS)))
    return rows.select(
        *kept,
        F.when(F.col("__n") > 0, name_of(F.col("__ll"))).alias("text_lang"),
        name_of(F.col("__post")).alias("lang_id"),
        best.alias("lang_posterior"),
        enough.alias("lang_accepted"),
    )
