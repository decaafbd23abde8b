"""The queries of this subpackage: one per operator, with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, bpe, collocations, fagin, jaccard_join, licenses, quality_mcd, spelling, tiling, token_spans, toxicity_crf, urlfilter, warc
from .common import remainder, table


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of ``documents``, with the offsets of toxic spans (code points, ``start-end``); rows with remainder 0 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_crf.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity_crf.score(docs, model)
    spans = F.array_join(F.zip_with("span_starts", "span_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ",").alias("spans")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("span_starts").alias("n_spans"), spans)


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust outliers per language and source over all of ``documents``."""
    return quality_mcd.judge(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links of 4-word shingle sets with 85 of 100 in common, over all of ``documents``."""
    return jaccard_join.link(table(spark, sf_dir, "documents"), jaccard_join.Scheme(4, 85, 100))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of ``documents``; rows with remainder 0 are held out of the counts."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page of ``pages`` and assemble its transaction again."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages``."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered signature rules over every text of ``documents``."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of ``benchmark`` in all of ``documents``."""
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    """Where the public byte-level BPE file is (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text of ``documents``; the counts of the lines as one text."""
    out = token_spans.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("section_tokens", F.array_join(F.col("section_tokens").cast("array<string>"), ","))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of ``documents``."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_fagin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of ``embeddings`` for each row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return fagin.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations.report(table(spark, sf_dir, "documents"))


#: All pairs of a query and a row; ``list_transform`` gives the same integers as doubles.
OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_crf": op1_toxicity_crf,
        "op2_quality_mcd": op2_quality_mcd,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_bloom_lm": op4_bloom_lm,
        "op6_license_rules": op6_license_rules,
        "op5_warc": op5_warc,
        "op7_url_filter": op7_url_filter,
        "op8_string_tiling": op8_string_tiling,
        "op9_bpe_transducer": op9_bpe_transducer,
        "op10_token_spans": op10_token_spans,
        "op11_spelling": op11_spelling,
        "op12_fagin_topk": op12_fagin_topk,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_fagin_topk": OP12_SQL}
