"""The registered queries of this subpackage. Each runs its operator over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, fingerprints, language, licenses, neardups, packing, pieces, scoring, search, sharding, substrings, treap, warc


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_words")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_documents(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language.held_out(5, 0)
    out = language.identify(docs, language.references(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def neardups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(_documents(spark, sf_dir))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def license_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/n/doc_id, with every 50th a LICENSE of source/lang and every 250th one of source."""
    name = F.concat_ws("/", (F.col("doc_id") / 64).cast("long").cast("string"), F.col("doc_id").cast("string"))
    top = F.when(F.col("doc_id") % 250 == 0, F.concat(F.col("source"), F.lit("/LICENSE")))
    path = F.coalesce(top, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(name)))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_files(license_files(_documents(spark, sf_dir))).withColumnRenamed("file_id", "doc_id")


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.top_k(_documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)
    return out.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compare_with_next(_documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language.held_out(7, 2)
    out = scoring.score_documents(_documents(spark, sf_dir), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def treap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.top_k(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


def _terms_sql(table: str, key: str) -> str:
    """A row for each term of each text."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table} WHERE text IS NOT NULL"


TREAP_SQL = f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql("documents", "doc_id")}) GROUP BY 1, 2), q AS (SELECT DISTINCT item_id, term FROM ({_terms_sql("benchmark", "item_id")})),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY 1), a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM s, a), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, a GROUP BY term, docs),
f AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 50"""


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.archive_dir(spark)
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1: four characters of each five hex digits.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), h AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1]), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to FROM h"""


def centroids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _centroids_sql(rounds: int = centroids.ROUNDS) -> str:
    """The same rounds as a chain of tables; whole numbers throughout."""
    near = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    made = [
        """k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v FROM k QUALIFY cluster < 8)",
    ]
    for r in range(rounds + 1):
        made.append(f"a{r} AS MATERIALIZED (SELECT k.vec_id, any_value(k.v) AS v, arg_min(c.cluster, ({near}, c.cluster)) AS cluster, min({near}) AS distance FROM k, c{r} c GROUP BY k.vec_id)")
        if r < rounds:
            made.append(f"""u{r} AS (SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list(m ORDER BY i) AS v FROM u{r} GROUP BY 1), c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""WITH {", ".join(made)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding_query,
        "op2_pieces": pieces_query,
        "op3_language": language_query,
        "op4_ngram_join": neardups_query,
        "op5_packing": packing_query,
        "op6_substrings": substrings_query,
        "op7_licenses": licenses_query,
        "op8_fingerprints": fingerprints_query,
        "op9_search": search_query,
        "op10_scoring": scoring_query,
        "op11_treap": treap_query,
        "op12_warc": warc_query,
        "op13_centroids": centroids_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_treap": TREAP_SQL, "op12_warc": WARC_SQL, "op13_centroids": _centroids_sql()}
