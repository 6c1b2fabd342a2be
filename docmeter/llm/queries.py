"""Registered queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, scratch, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import END, START, read_back, windows

    said = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(windows(rows))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "warc")
    return read(write(pages, folder), folder, kind=pages.schema["page_id"].dataType.simpleString())


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 4) != 2)
    out = score(docs, machine, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, learn=crc_mod("doc_id", 5) != 0), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_packing, op3_quality_rules, op4_chat_format, op5_mixing, op6_token_counts, op7_toxicity, op8_warc, op9_top_k, op10_language_id)}
ORACLES: dict[str, str] = {
    "op1_near_duplicates": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
        b AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (4 * strpos('0123456789abcdef', c) - 3)::INT, 4)), '') AS bits FROM s)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, (5 * i + j + 1)::INT, 1) = '1' THEN 2 ** (4 - j) ELSE 0 END)))::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM b""",
    "op4_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text)),
        e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
        n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) + 4 AS n,
                     length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<|', '|'))) AS body,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
        s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS b FROM n),
        w AS (SELECT *, 2 * (b // 1024) + CASE WHEN b + n > (b // 1024 + 1) * 1024 AND b > (b // 1024) * 1024 THEN 1 ELSE 0 END AS win, body + length(role) + 24 AS size FROM s),
        f AS (SELECT *, coalesce(win <> lag(win) OVER (PARTITION BY conv_id ORDER BY i), true) AS head,
                     count(*) OVER (PARTITION BY conv_id ORDER BY b RANGE BETWEEN 512 PRECEDING AND CURRENT ROW) - 1 AS back FROM w),
        again AS (SELECT h.conv_id, sum(x.size) AS size FROM f h JOIN f x ON h.conv_id = x.conv_id AND h.head AND x.i < h.i
                  AND (x.i >= h.i - h.back OR (x.i = 1 AND x.role = 'system')) GROUP BY 1)
        SELECT f.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
               (sum(f.size) + coalesce(max(again.size), 0))::BIGINT AS formatted_chars
        FROM f LEFT JOIN again ON again.conv_id = f.conv_id GROUP BY f.conv_id""",
    "op9_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
