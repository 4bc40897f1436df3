"""The operators as queries over the supplied tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import crc_of, table
from tickloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        _QUERIES[name] = configured
        return configured

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


@query("op10_repeated_strings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.repeats import removed, repeats

    return removed(repeats(table(spark, sf_dir, "documents")))


@query("op6_minhash_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"), crc_of("doc_id") % 5 != 0)
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, lexicon).select("doc_id", held_out, "score", "predicted")


@query("op3_languages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, crc_of("doc_id") % 4 != 2)
    held_out = F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "shares")


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    ids = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_differencing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.packing import cut, pack

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(cut(docs, public_tokenizers.path("word_bpe_49k.json"), added=True))


@query("op2_transactions")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.warc import page_digests

    return page_digests(table(spark, sf_dir, "pages"))


_ORACLES["op2_transactions"] = """
SELECT page_id,
       strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


@query("op1_lattice_vectors")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


_ORACLES["op1_lattice_vectors"] = """
WITH RECURSIVE clean AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x <> 0]) > 0
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN smallest USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
"""


@query("op4_block_max_search")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.search import top_k

    return top_k(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 100 == 0)


_ORACLES["op4_block_max_search"] = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term
    FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, coalesce(n, 0) AS length FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) USING (doc_id)),
stats AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM lengths),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
scored AS (
    SELECT q.doc_id AS query_id, d.doc_id,
           sum(floor(ln(1 + (n - df + 0.5) / (df + 0.5))
               * (d.tf::DOUBLE * (1.2::DOUBLE + 1) / (d.tf::DOUBLE + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)))
               * 1000000 + 0.5)::BIGINT) AS units
    FROM tf q JOIN df USING (term) JOIN tf d USING (term) JOIN lengths l ON l.doc_id = d.doc_id CROSS JOIN stats
    WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, rank::INTEGER AS rank, doc_id, units::DOUBLE / 1000000 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


@query("op5_ordinal_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded 0: poor, 1: good but toxic, 2: good and not toxic."""
    from tickloom.llm.quality import grade, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2))
    ratings = table(spark, sf_dir, "labels").select("doc_id", good.alias("grade"))
    model = learn(docs, ratings, crc_of("doc_id") % 5 != 0)
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return grade(docs, model).select("doc_id", held_out, "expected_grade", "tail", "kept")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.conversations import damaged, repair

    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_stateful_digests")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.exact import exact_duplicates

    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_ORACLES["op13_stateful_digests"] = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
      FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))
"""
