"""The corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import filteraudit, htmltext, langid, license, maxscore, media, mixing, packing, simhash, substring, urlfilter, vectorcodes, warc
from tapewright.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id's digest gives, against a dated list made from the table's own hosts."""
    pages = table(spark, sf_dir, "pages")
    mix = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("int")
    captures = pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2023-01-01")), mix % 900).alias("fetch_day"))
    out = urlfilter.evaluate(captures, urlfilter.sample_list(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetch_day", "valid_from")})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence evidence of every document, with the number of its expressions and whether permissive terms meet them."""
    return license.scan_licenses(table(spark, sf_dir, "documents")).withColumn("expressions", F.size("expressions"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_vectors(table(spark, sf_dir, "embeddings"))


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media,
        op2_maxscore,
        op3_pack,
        op4_rlz,
        op5_urlfilter,
        op6_warc,
        op7_language,
        op8_simhash,
        op9_licenses,
        op10_mix,
        op11_vectorcodes,
        op12_filteraudit,
        op13_htmltext,
    )
}
