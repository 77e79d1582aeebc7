"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, digest_index, langid, merkle, mixing, neardup, negatives, pieces, pii, repeats, shards, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents' passes in the training sequence take together."""
    passes = mixing.sequence(_table(spark, sf_dir, "documents"))
    about = ["doc_id", "size", "source_size", "target"]
    return passes.groupBy("rank", "part", "nth").agg(*[F.first(c).alias(c) for c in about], F.sum("words").alias("taken")).select(*about, "taken")


def default_model_file(spark: SparkSession | None = None) -> str:
    """The SentencePiece model that ``spark.weirstream.model`` names, else the public one that this machine has."""
    if spark is not None and (given := spark.conf.get("spark.weirstream.model", None)):
        return given
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every whole text, and whether decoding them gives the text again."""
    vocabulary = pieces.load(default_model_file(spark))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    rows = pieces.encoded(docs, vocabulary).drop("text")
    rows = pieces.decoded(rows, vocabulary)
    same = F.octet_length("decoded").eqNullSafe(F.col("size")) & (F.xxhash64("decoded") == F.col("hash"))
    return rows.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_byte_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        "ids",
        same.alias("round_trip"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = langid.learn(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.NearDup(words=4, similarity=80))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return rows.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest_index.exact_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> count the base spans, n_spans all of them and n_secret the added keys and tokens."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit(spark))
    counts = [F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base, everything = pii.in_order(F.col("base")), pii.in_order(F.concat("base", "added"))
    added = [F.size(F.filter("added", pii.is_kind("secret"))).cast("long").alias("n_secret"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(everything).alias("spans"), *added)


URL_RULES = [
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.external_shuffle(_table(spark, sf_dir, "documents"), n_shards=16)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), topk.quantised(F.col("embedding")).alias("v"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, k=10, positives=5, low=30, high=90)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations replayed as a log, folded, rendered and read back."""
    controls = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", controls), (-1, 1, "assistant", controls)], "conv_id long, turn long, role string, text string")
    log = chat.logged(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    rows = chat.read_back(chat.formatted(log).withColumn("formatted_chars", F.length("formatted").cast("long")))
    turns = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return rows.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; a seventh of them are checked in a tampered state."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered, leaf(F.col("n_chars") + 1))
    rows = merkle.manifest(docs, leaf(F.col("n_chars")), claimed=claimed).withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("proof")))
    proof = merkle.proof_digest(F.col("proof")).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_minhash": op5_minhash,
    "op6_suffix": op6_suffix,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat": op12_chat,
    "op13_merkle": op13_merkle,
}

ORACLE = {
    "op5_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS shingle
            FROM w, range(1, greatest(len(w) - 2, 2)) r(i) WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), inter AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), least AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least ON d.doc_id = least.a LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op1_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        ), scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_mixing": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(text, '')) AS tie, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), per_source AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per_source
        ), weighted AS (
            SELECT *, [3.0, 1.0, 2.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked
        ), steps AS (
            SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
                   coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                   sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
            FROM weighted
        ), level AS (
            SELECT arg_min((total - caps) / weights, (cap / weight, rank)) AS level FROM steps WHERE (total - caps) / weights * weight < cap
        ), targets AS (
            SELECT w.source, source_size, least(cap, coalesce(level, cap / weight) * weight)::DOUBLE AS target FROM weighted w, level
        ), placed AS (
            SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, t.target,
                   (sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id, s.size, tie ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size))
                + greatest(0, least(size, floor(target)::BIGINT - start - 2 * source_size)))::BIGINT AS taken
        FROM placed
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        ), scored AS (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row AS row, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row)::INT AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10
    """,
    "op12_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), s AS (
            SELECT *, length('<s>' || url_encode(role) || chr(10) || '</s>') + length(text) + CASE WHEN role = 'user' THEN length('[INST]  [/INST]') ELSE 0 END
                      + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS size FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(size)::BIGINT AS formatted_chars
        FROM s GROUP BY conv_id
    """,
    "op13_merkle": r"""
        WITH RECURSIVE crc(byte, value, bit) AS (
            SELECT range, range::UBIGINT, 0 FROM range(256)
            UNION ALL SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384::UBIGINT) ELSE value >> 1 END, bit + 1 FROM crc WHERE bit < 8
        ), crcs AS MATERIALIZED (
            SELECT list(value ORDER BY byte) AS t FROM crc WHERE bit = 8
        ), base AS (
            SELECT row_number() OVER () AS row, doc_id, lang, n_chars,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
                   coalesce(strlen(text) || ':' || text, '-') AS behind,
                   xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                       lambda a, b: xor(t[(xor(a, b) & 255)::INT + 1], a >> 8)), 4294967295::UBIGINT) % 7 = 0 AS tampered
            FROM documents, crcs
        ), leaves AS MATERIALIZED (
            SELECT row, doc_id, lang, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || behind) AS leaf,
                   sha256(before || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT), '-') || behind) AS claimed
            FROM base
        ), placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
        ), nodes(lang, level, pos, value, n) AS (
            SELECT lang, 0, pos, leaf, n FROM placed
            UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(value, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
        ), subroots AS MATERIALIZED (
            SELECT lang, value AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops(level, pos, value, n) AS (
            SELECT 0, pos, subroot, n FROM subroots
            UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(value, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
        ), steps AS (
            SELECT p.row, p.pos, l.level, l.level AS step, l.lang IS NULL AS lone, l.lang, 'tree' AS tree FROM placed p
            JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
            UNION ALL SELECT p.row, s.pos, t.level, 1000 + t.level, false, NULL, 'top' FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
            CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) t
        ), every AS (
            SELECT 'tree' AS tree, * FROM nodes UNION ALL SELECT 'top', NULL, * FROM tops
        ), proofs AS (
            SELECT s.row, string_agg(e.value, '' ORDER BY step) AS proof,
                   list(CASE WHEN e.value IS NULL THEN '=' WHEN (s.pos >> s.level) & 1 = 1 THEN '<' || e.value ELSE '>' || e.value END ORDER BY step) AS path
            FROM steps s LEFT JOIN every e ON e.tree = s.tree AND e.lang IS NOT DISTINCT FROM s.lang AND e.level = s.level AND e.pos = xor(s.pos >> s.level, 1)
            GROUP BY s.row
        ), folded AS (
            SELECT p.*, subroot, (SELECT value FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                   list_reduce(list_prepend(claimed, coalesce(path, [])), lambda a, x: sha256(CASE x[1] WHEN '<' THEN x[2:] || a WHEN '>' THEN a || x[2:] ELSE a END)) AS folded_root
            FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proofs ON proofs.row = p.row
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """,
}
