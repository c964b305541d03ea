"""The registered query of each operator, thin over the operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests, format_chat
from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html import main_text
from .language import identify
from .packing import pack
from .quality import classify
from .repeats import digest, remove_repeats
from .simhash import near_duplicates
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents"), length=200))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=5, held=0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chat(turns))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_repeats": op7_repeats,
    "op8_language": op8_language,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH doc AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents
        ), item AS (
            SELECT min(item_id) AS item_id, h
            FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM benchmark)
            GROUP BY h HAVING len(h) >= 8
        ), mask AS (
            SELECT * FROM (VALUES (0, [0, 1, 2, 4, 5, 7]), (1, [0, 1, 3, 4, 6, 7]), (2, [0, 2, 3, 5, 6, 7])) t(mask, kept)
        ), doc_pos AS (SELECT doc_id, h, unnest(range(0, len(h) - 7)) AS pos FROM doc WHERE len(h) >= 8
        ), item_pos AS (SELECT item_id, h, unnest(range(0, len(h) - 7)) AS pos FROM item
        ), doc_seed AS (
            SELECT doc_id, pos, mask, list_transform(kept, lambda k: h[pos + k + 1]) AS seed FROM doc_pos, mask
        ), item_seed AS (
            SELECT item_id, pos, mask, list_transform(kept, lambda k: h[pos + k + 1]) AS seed FROM item_pos, mask
        ), laid AS (
            SELECT DISTINCT d.doc_id, i.item_id, d.pos - i.pos AS lay FROM doc_seed d JOIN item_seed i USING (mask, seed)
        ), one AS (
            SELECT l.doc_id, l.item_id, l.lay, k, len(i.h) AS item_n,
                   CASE WHEN d.h[l.lay + k + 1] = i.h[k + 1] THEN 1 ELSE -3 END AS s
            FROM laid l JOIN doc d ON d.doc_id = l.doc_id JOIN item i ON i.item_id = l.item_id, unnest(range(0, len(i.h))) u(k)
            WHERE l.lay + k >= 0 AND l.lay + k < len(d.h)
        ), run AS (
            SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, lay ORDER BY k) AS upto FROM one
        ), best AS (
            SELECT doc_id, item_id, item_n,
                   upto - least(0, coalesce(min(upto) OVER (PARTITION BY doc_id, item_id, lay ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score
            FROM run
        )
        SELECT doc_id, item_id, max(score)::BIGINT AS overlap FROM best
        GROUP BY doc_id, item_id HAVING max(score) >= least(13, ceil(any_value(item_n) * 0.9))
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), marked AS (
            SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS conflict,
                   length(regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|\\)', '_\1', 'g')) AS escaped_chars
            FROM turns
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum(length(role) + length(text) + 17) + 3 AS plain_chars, sum(length(role) + escaped_chars + 17) + 4 AS escaped_chars,
                   bool_or(conflict) AS conflict
            FROM marked GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
               (CASE WHEN conflict THEN escaped_chars ELSE plain_chars END)::BIGINT AS formatted_chars
        FROM whole
    """,
}
