"""The queries over the test tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, containment, filter_audit, quality, shards, simhash, site_style, spelling, token_counts, token_files, vector_graph, warc
from .common import new_dir, table, workers_find_us
from .vocabulary import default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_us(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = registered
    return registered


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of documents, compacted; what the last version's files hold."""
    docs = table(spark, sf_dir, "documents")
    store = shards.Store(spark, new_dir(spark, "shards"), docs.schema, target_bytes=64 << 20, rows_a_shard=2_000)
    for arrival in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == arrival))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE["op1_sharding"] = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, decodes the ids, and gives digests of both."""
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), default_path())
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses in WARC files, their derivatives in others; a row for each page from what is read back.

    Rows of pages that are equal in all columns have records with equal ids, and give as many equal rows.
    """
    sources, derived = new_dir(spark, "warc"), new_dir(spark, "warc-derived")
    warc.write_warc(warc.responses(table(spark, sf_dir, "pages")), sources)
    warc.write_warc(warc.derive(warc.read_warc(spark, sources)), derived)
    found = warc.read_warc(spark, derived)
    field = lambda name: F.regexp_extract(F.decode("block", "UTF-8"), rf"(?m)^{name}: (.*?)\r?$", 1)
    rows = found.select(
        F.col("headers")["X-Source-Row"].cast("long").alias("page_id"),
        F.col("headers")["WARC-Refers-To"].alias("refers_to"),
        F.col("headers")["WARC-Target-URI"].alias("url"),
        F.struct(F.col("headers")["WARC-Type"].alias("kind"), F.col("headers")["WARC-Record-ID"].alias("id"), F.col("headers")["WARC-Concurrent-To"].alias("with_"), F.when(F.col("headers")["WARC-Type"] == "metadata", field("source-payload-digest")).alias("payload"), F.when(F.col("headers")["WARC-Type"] == "metadata", field("source-header-Content-Length").cast("long")).alias("n_bytes"), F.sha2("block", 256).alias("sha256"), F.length(F.decode("block", "UTF-8")).cast("long").alias("n_chars")).alias("r"),
    )
    kind = lambda name, column: F.max(F.when(F.col("r.kind") == name, F.col(f"r.{column}")))
    pages = rows.groupBy("page_id", "refers_to", "url").agg(kind("metadata", "id").alias("metadata_id"), kind("conversion", "id").alias("conversion_id"), kind("metadata", "payload").alias("payload_digest"), kind("metadata", "n_bytes").alias("n_bytes"), kind("conversion", "n_chars").alias("n_chars"), kind("conversion", "sha256").alias("text_sha256"), (kind("metadata", "with_") == kind("conversion", "id")).alias("linked"), F.count(F.when(F.col("r.kind") == "metadata", 1)).alias("copies"))
    return pages.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return containment.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op5_decontamination"] = containment.ORACLE


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, and gives digests of what is read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("conv_id", "x.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.parse_chats(chat.format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE["op6_chat_format"] = chat.ORACLE


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


ORACLE["op7_quality_rules"] = quality.ORACLE


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as files and gives what is read back from them."""
    target = new_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), target, default_path(), end_id=2)
    return token_files.read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), default_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at a cosine of 0.95 and the component that these lead to."""
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = filter_audit.ORACLE


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the forms that they are variants of."""
    return spelling.variants(table(spark, sf_dir, "documents"))
