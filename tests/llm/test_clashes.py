"""Every operator and stage on tables with columns named like its own results, and on empty tables."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from conftest_llm import sample_rows
from pyspark.sql import functions as F

from gridloom.llm import alignment, byte_bpe, exact_dedup, html_text, language, mixing, quality, simhash, token_files, toxicity, warc

OTHERS = "score ids decoded lang_pred main_text segments row fp kept keep_id component_id taken size source_size target copies stratum good half root first least digit rest uid group n label form aside bucket k0 t0 of tie place _file _row _metadata record_type payload file base_failed n_words Score".split()
RANKS, MULTI, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def labels(docs):
    return docs.where("doc_id is not null").selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic").distinct()


OPERATORS = {
    "exact_dedup": lambda docs: exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "text_sha256"),
    "exact_dedup_carry": lambda docs: exact_dedup.exact_dedup(docs, carry=True).select("doc_id", "keep_id", "row.text"),
    "language": lambda docs: language.predict(docs, language.fit(docs, MULTI)).select("doc_id", "lang_pred"),
    "byte_bpe": lambda docs: byte_bpe.encode(docs, RANKS, P.PATTERN, with_decoded=True).select("doc_id", "ids", "decoded"),
    "byte_bpe_decode": lambda docs: byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).select("doc_id", "ids", "decoded"),
    "token_files": lambda docs: token_files.read_token_files(docs.sparkSession, token_files.write_token_files(docs, JSON)).select("doc_id", "ids"),
    "alignment": lambda docs: alignment.align(docs, JSON, P.path("piece_bpe_32k.model")),
    "simhash": lambda docs: simhash.near_duplicates(docs).select("doc_id", "fp", "component_id"),
    "mixing": lambda docs: mixing.mix(docs),
    "mixed_rows": lambda docs: mixing.mixed_rows(docs).select("doc_id", "text"),
    "quality": lambda docs: quality.judge(docs, labels(docs)),
    "toxicity": lambda docs: toxicity.score(docs, toxicity.fit(docs, labels(docs)), with_segments=True).select("doc_id", F.round("score", 9).alias("rounded")),
    "html_text": lambda docs: html_text.extract(docs, html_col="text").select("doc_id", "main_text"),
    "warc": lambda docs: warc.read_archives(docs.sparkSession, warc.write_archives(docs, "doc_id", "lang", "text")).select("page_id", "record_type", "payload_digest"),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with and without other columns, their labels beside each."""
    out = {}
    rows = [r for r in sample_rows(count=60) if r[1] is None or len(r[1]) < 50_000]
    for name, given in (("plain", rows), ("empty", [])):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string").repartition(3)
        for kind, table in ((name, docs), (f"{name}-others", docs.select("*", *[F.lit("other").alias(c) for c in OTHERS if c != "Score"], F.lit("other").alias("a `strange`.name")))):
            folder = str(tmp_path_factory.mktemp(kind))
            table.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
            labels(docs).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
            out[kind] = (spark.read.parquet(f"{folder}/documents.parquet"), folder)
    return out


def result(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(tables, name):
    operator = OPERATORS[name]
    got = result(operator(tables["plain-others"][0]))
    assert got == result(operator(tables["plain"][0])) and (got or name == "warc")
    assert result(operator(tables["empty"][0])) == [] == result(operator(tables["empty-others"][0]))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_carry_other_columns(spark, tables, name, stage):
    plain, others = (stage(spark, *tables[k]) for k in ("plain", "plain-others"))
    assert stage(spark, *tables["empty-others"]).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert others.columns == tables["plain-others"][0].columns
        assert others.where(" or ".join(f"`{c}` != 'other'" for c in OTHERS if c != "Score")).count() == 0
    assert result(others.select(plain.columns)) == result(plain)
