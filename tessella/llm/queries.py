"""The thin queries over the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, linededup, lm, mixing, pii, simhash, vectordup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the contract; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (host, markup) in one result; a page's doc_id is -1 - page_id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.train(docs)
    none = F.lit(None).cast("string")
    d = docs.select(F.lit("document").alias("record"), "doc_id", "text", F.col("source").alias("host"), none.alias("declared"))
    p = pages.select(
        F.lit("page").alias("record"),
        (-1 - F.col("page_id")).alias("doc_id"),
        langid.html_text(F.col("html")).alias("text"),
        langid.url_host(F.col("url")).alias("host"),
        langid.html_language(F.col("html")).alias("declared"),
    )
    return langid.identify(d.union(p), model, host="host", declared="declared", keep=["record", "doc_id"])


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.bpe_round_trip(docs, tokenizer_path(), carry=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.vector_groups(table(spark, sf_dir, "embeddings"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_repeats")).alias("taken"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; a query that anyone can rerun has to name one."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="not a secret")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rows(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_simhash": op3_simhash,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_nearest": op5_nearest,
    "op6_mix": op6_mix,
    "op7_pii": op7_pii,
    "op8_lm_score": op8_lm_score,
    "op9_licenses": op9_licenses,
    "op10_line_dedup": op10_line_dedup,
}

#: Vectors that take part, as doubles.
_VECTORS = "select vec_id, label, e from (select vec_id, label, embedding::double[] as e from embeddings) where len(e) > 0 and len(list_filter(e, lambda x: x is not null and isfinite(x))) = len(e) and list_dot_product(e, e) > 0"

ORACLE_SQL: dict[str, str] = {
    # all pairs of a label, and the nodes that links reach
    "op4_vector_dedup": f"""with recursive v as ({_VECTORS}), links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reached as (select vec_id as node, vec_id as other from embeddings union select node, b from reached join links on a = other)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept
from (select node as vec_id, min(other) as component_id from reached group by node)""",
    # all pairs: what the curves find where a table has no more rows than the least window
    "op5_nearest": f"""with v as ({_VECTORS}) select query_id, rank::int as rank, vec_id, score from (select q.vec_id as query_id, c.vec_id as vec_id, score, row_number() over (partition by q.vec_id order by score, c.vec_id) as rank
from (select q, c, sqrt(list_sum(list_transform(q.e, lambda x, i: (x - c.e[i]) * (x - c.e[i])))) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)) where rank <= 10""",
    # lines within an edit are equal without one character of each, at one place, or one is the other without a character
    "op10_line_dedup": """with texts as (select doc_id, string_split(text, chr(10)) as all_lines from documents where text is not null),
occurrences as (select doc_id, unnest(all_lines) as line, generate_subscripts(all_lines, 1) as n from texts),
firsts as (select line, min({'d': doc_id, 'n': n}) as f from occurrences where line <> '' group by line),
shorter as (select line, f, i, substring(line, 1, i - 1) || substring(line, i + 1) as rest from (select line, f, unnest(range(1, length(line) + 1)) as i from firsts where length(line) > 1)),
gone as (select line from (select line, f, min(f) over (partition by i, rest) as least from shorter) where f > least
union select s.line from shorter s join firsts o on s.rest = o.line where o.f < s.f union select o.line from shorter s join firsts o on s.rest = o.line where s.f < o.f),
marked as (select o.doc_id, o.n, o.line, o.line = '' or (g.line is null and f.f = {'d': o.doc_id, 'n': o.n}) as stays from occurrences o left join firsts f on o.line = f.line left join gone g on o.line = g.line),
built as (select doc_id, coalesce(string_agg(line, chr(10) order by n) filter (stays), '') as text, count(*) filter (not stays) as n_dropped from marked group by doc_id)
select d.doc_id, b.text, coalesce(b.n_dropped, 0)::int as n_dropped from documents d left join built b on d.doc_id = b.doc_id""",
}
