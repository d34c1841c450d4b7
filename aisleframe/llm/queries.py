"""Registered queries of the pipeline operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm import bpe, chat, decontam, exact_dedup, extract, negatives, pii, quality, runs, secrets, simhash, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_simhash_vantage_tree")
def op5(spark, folder):
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select(
        "doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id"
    )


@query(
    "op9_patricia_owners",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9(spark, folder):
    found = exact_dedup.groups(table(spark, folder, "documents"), keep="max")
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_chunked_bpe")
def op10(spark, folder):
    found = bpe.tokens(table(spark, folder, "documents"), tokenizer_path())
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_ordinal_toxicity")
def op7(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


@query("op1_spaced_seed_decontamination")
def op1(spark, folder):
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def span_columns(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.transform(own, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


@query("op8_anchored_pii")
def op8(spark, folder):
    return span_columns(pii.personal_data(table(spark, folder, "documents")), pii.BASE)


@query("op4_blob_ledger_secrets")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    return span_columns(secrets.findings(docs, secrets.extended(docs)), secrets.BASE)


# The roles of the table hold no control strings, so only texts grow by escaping.
@query("op6_prefix_target_chat", r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    p AS (SELECT *, role = 'assistant' AS target, 9 + length(role) + length(regexp_replace(text,
            '(<|\[)(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1x\2\3', 'g')) AS n FROM t),
    e AS (SELECT *, sum(n) OVER w AS until, lead(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS closing
          FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (target), '')) AS loss_sha256,
           sum(until) FILTER (target OR closing)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """)
def op6(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema
    )
    written = chat.pieces(turns.unionByName(more))
    return chat.read_back(written, chat.examples(written))


@query("op2_host_suffix_array")
def op2(spark, folder):
    found = extract.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def held_out(doc_id="doc_id"):
    """Rows that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


@query("op3_crf_quality")
def op3(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.scored(docs, quality.fit(docs, labels, learn=~held_out()))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op13_minimizer_runs")
def op13(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return runs.summary(runs.periodic_runs(runs.with_planted_runs(docs)))


@query("op12_kronecker_negatives", """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             list_inner_product(a.q, c.q)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.other_id AS positive_id,
           row_number() OVER w::INT AS rank, s.other_id AS negative_id,
           p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
      AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)
    QUALIFY row_number() OVER w <= 3
    """)
def op12(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op11_association_rules", r"""
    WITH cut AS (
      SELECT page_id, url, strpos(coalesce(url, ''), '://') AS cut_at FROM pages),
    rest AS (
      SELECT *, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest,
             CASE WHEN cut_at > 0 THEN translate(substr(url, 1, cut_at - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS scheme
      FROM cut),
    parts AS MATERIALIZED (
      SELECT *, row_number() OVER () AS n_row,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query,
             regexp_extract(rest, '(?s)#(.*)', 1) AS fragment
      FROM rest),
    raw AS (
      SELECT n_row, 's:' AS kind, scheme AS word FROM parts
      UNION ALL SELECT n_row, 'h:', unnest(string_split(host, '.')) FROM parts
      UNION ALL SELECT n_row, 'p:', regexp_replace(unnest(string_split(path, '/')), '[0-9]+', '0', 'g') FROM parts
      UNION ALL SELECT n_row, 'q:', regexp_replace(split_part(unnest(string_split(query, '&')), '=', 1), '[0-9]+', '0', 'g') FROM parts
      UNION ALL SELECT n_row, 'f:', regexp_replace(fragment, '[0-9]+', '0', 'g') FROM parts),
    tokens AS (
      SELECT DISTINCT n_row, kind || CASE WHEN length(word) > 64 THEN md5(word) ELSE word END AS token FROM raw WHERE word <> ''),
    marks AS (
      SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
      FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
    learnt AS (SELECT n_row, bad FROM parts JOIN marks ON page_id = doc_id),
    least AS (SELECT greatest(5, (count(*) + 63) // 64) AS least FROM learnt),
    words AS (
      SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS place
      FROM learnt JOIN tokens USING (n_row) WHERE bad GROUP BY token
      HAVING count(*) >= (SELECT least FROM least) QUALIFY place <= 256),
    items AS (
      SELECT n_row, bad, token, place FROM learnt JOIN tokens USING (n_row) JOIN words USING (token)
      QUALIFY row_number() OVER (PARTITION BY n_row ORDER BY place) <= 12),
    sets AS (
      SELECT bad, [token] AS combo FROM items
      UNION ALL SELECT a.bad, [a.token, b.token] FROM items a JOIN items b ON a.n_row = b.n_row AND a.place < b.place
      UNION ALL SELECT a.bad, [a.token, b.token, c.token] FROM items a JOIN items b ON a.n_row = b.n_row AND a.place < b.place
        JOIN items c ON b.n_row = c.n_row AND b.place < c.place),
    rules AS (
      SELECT combo, count(*) FILTER (bad) / count(*) AS confidence FROM sets GROUP BY combo
      HAVING count(*) FILTER (bad) >= (SELECT least FROM least) AND confidence >= 0.5),
    fit AS (
      SELECT t.n_row, confidence, array_to_string(combo, ' ') AS terms
      FROM rules JOIN tokens t ON t.token = combo[-1]
        LEFT JOIN tokens u ON u.n_row = t.n_row AND len(combo) > 1 AND u.token = combo[1]
        LEFT JOIN tokens v ON v.n_row = t.n_row AND len(combo) > 2 AND v.token = combo[2]
      WHERE (len(combo) < 2 OR u.token IS NOT NULL) AND (len(combo) < 3 OR v.token IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY t.n_row ORDER BY confidence DESC, len(combo), array_to_string(combo, ' ')) = 1),
    listed AS (
      SELECT *, CASE
        WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN terms IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, terms, confidence
    FROM listed LEFT JOIN fit USING (n_row)
    """)
def op11(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judged(pages, urls.mine(urls.labelled_pages(pages, table(spark, folder, "labels")), exact=True))
