"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import crc_mod


#: No source is repeated more often than this; the least repeated one is used once.
MAX_REPETITION = 1.5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.exact_dedup import exact_dedup

    found = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.mixing import mix

    found = mix(documents(spark, sf_dir), max_repetition=MAX_REPETITION)
    return found.withColumnRenamed("id", "doc_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from peakloom.llm.sentencepiece_bpe import round_trip

    found = round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.suffix_dedup import drop_repeats

    found = drop_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    # n_bytes is the input's size; what is left comes as text, in which bytes that a cut leaves without their character are U+FFFD
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", text.alias("text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.secret_scan import KINDS, scan_documents

    found = scan_documents(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count(KINDS[3]), F.array_max("secrets.cost").alias("top_cost"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.warc import archive_pages
    from peakloom.session import scratch_path

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = archive_pages(pages, scratch_path(spark, "warc"), payloads=False)
    fields = F.col("metadata.fields")
    return captures.select(
        fields["capture-id"].cast("long").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes"), fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce(F.col("response.computed_digest"), F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        fields["refers-to-capture"].cast("long").alias("refers_to"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm import language_id

    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.multi_index import nearest

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors, F.col("vec_id") % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.minhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir), width=4, percent=80)
    return found.withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm import quality

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 5) == 0
    model = quality.fit(docs, labels, held_out=held_out)
    found = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from peakloom.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_bytes=True)
    found = byte_bpe.decode_ids(encoded, path)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm import annulus

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = annulus.with_digests(*annulus.cluster(vectors))
    return found.withColumnRenamed("id", "vec_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakloom.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_source_mixing, op3_sentencepiece, op4_suffix_dedup, op5_secret_scan, op6_warc, op7_language_id, op8_ann, op9_minhash, op10_quality, op11_byte_bpe, op12_centroids, op13_collocations)}


def centroids_sql(rounds: int = 3) -> str:
    """k-means of op12 as one chain of common tables: each round assigns every vector and moves the centroids."""
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM v
                 ORDER BY sha256('1:' || vec_id) LIMIT 16)""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS b FROM v, c{k} GROUP BY vec_id, v)""")
        if k < rounds:
            parts.append(f"""s{k} AS (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS guess, sum(x) AS t, count(*) AS n FROM (SELECT b.c AS c, unnest(range(64)) AS i, unnest(v) AS x FROM a{k}) GROUP BY c, i),
              m{k} AS (SELECT c, list(CASE WHEN guess * n > t THEN guess - 1 WHEN (guess + 1) * n <= t THEN guess + 1 ELSE guess END ORDER BY i) AS m FROM s{k} GROUP BY c),
              c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))""")
    last = f"a{rounds}"
    return (
        "WITH " + ", ".join(parts) + f"""
        SELECT vec_id, b.c AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} ON c{rounds}.c = b.c"""
    )


ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, array_to_string(list_transform(range(4), lambda k: array_to_string(list_transform(range(8),
                  lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * k AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * j AS BIGINT)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
                  min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM q""",
    "op9_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                  ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
                  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
        FROM documents JOIN reach ON a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op12_centroids": centroids_sql(),
    "op13_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
              FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        h AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM h WHERE k > 1),
        parts AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(s[1:j], ' ') AS one, array_to_string(s[j + 1:], ' ') AS rest
                  FROM c, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
        cuts AS (SELECT parts.lang, parts.phrase, parts.k, a, j, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n,
                        (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS score
                 FROM parts JOIN h l ON l.lang = parts.lang AND l.phrase = one JOIN h r ON r.lang = parts.lang AND r.phrase = rest JOIN t ON t.lang = parts.lang),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (
            SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM kept QUALIFY rank <= 2000""",
}
