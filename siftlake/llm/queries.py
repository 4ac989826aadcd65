"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.shared import tables_dir


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by two co-trained views."""
    from siftlake.llm.cotraining import quality, train_on

    docs = tables_dir(spark, sf_dir, "documents")
    return quality(docs, train_on(docs, tables_dir(spark, sf_dir, "labels")))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the vocabulary file's own way and by the best-scoring path, and whether they decode to the text."""
    import public_tokenizers

    from siftlake.llm.sentence_pieces import encoded

    docs = tables_dir(spark, sf_dir, "documents")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), (None, "viterbi"), with_ids=False).drop("ids", "viterbi_ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 4096 tokens."""
    import public_tokenizers

    from siftlake.llm.packing import pack

    packed = pack(tables_dir(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.drop("ids").withColumnRenamed("queue", "source_queue")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    from siftlake.llm.ngram_join import ngram_join

    return ngram_join(tables_dir(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one with its neighbour's last answer, as a prompt and two masked completions."""
    from siftlake.llm.preference_format import conversations_of, format_preferences, graft_rejected, spans_text

    pairs = graft_rejected(conversations_of(tables_dir(spark, sf_dir, "conversations")))
    done = format_preferences(pairs)
    return done.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans_text("chosen_spans").alias("chosen_mask"), spans_text("rejected_spans").alias("rejected_mask"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from siftlake.llm.html_extract import extract

    return extract(tables_dir(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and whether it stays."""
    from siftlake.llm.exact_dedup import exact_dedup

    return exact_dedup(tables_dir(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rules and the verdict of the line labeller."""
    from siftlake.llm.quality_rules import quality_rules, train_on

    docs = tables_dir(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, train_on(docs, tables_dir(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that stand elsewhere."""
    from siftlake.llm.substring_dedup import digests, substring_dedup

    return digests(substring_dedup(tables_dir(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a tagger trained on the labelled rows outside the held-out fold."""
    from siftlake.llm.toxicity import held_out, toxicity, train_on

    docs = tables_dir(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, train_on(docs, tables_dir(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SQL = {
    "op5_preference_format": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
            FROM conversations),
        c AS (
            SELECT conv_id, count(*) AS n, coalesce(max(CASE WHEN role = 'assistant' THEN k END), count(*) + 1) AS cut
            FROM t GROUP BY conv_id),
        chosen AS (SELECT t.conv_id, k, role, text FROM t),
        rejected AS (
            SELECT t.conv_id, k, role, text FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE k < cut
            UNION ALL
            SELECT mine.conv_id, mine.cut + t.k - theirs.cut AS k, t.role, t.text
            FROM c AS mine JOIN c AS theirs ON theirs.conv_id = xor(mine.conv_id, 1) JOIN t ON t.conv_id = theirs.conv_id
            WHERE t.k >= theirs.cut),
        differ AS (
            SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.k, b.k) AS k
            FROM chosen a FULL JOIN rejected b ON a.conv_id = b.conv_id AND a.k = b.k
            WHERE a.k IS NULL OR b.k IS NULL OR a.role <> b.role OR a.text <> b.text),
        shared AS (
            SELECT c.conv_id, coalesce(min(d.k) - 1, max(c.n)) AS n_prompt_turns
            FROM c LEFT JOIN differ d ON d.conv_id = c.conv_id GROUP BY c.conv_id),
        sides AS (
            SELECT 'c' AS side, * FROM chosen UNION ALL SELECT 'r' AS side, * FROM rejected),
        piece AS (
            SELECT s.side, s.conv_id, s.k, s.role, n_prompt_turns,
                   '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece, length(text) AS size
            FROM sides s JOIN shared USING (conv_id)),
        placed AS (
            SELECT *, coalesce(sum(length(piece)) OVER (
                       PARTITION BY side, conv_id, k > n_prompt_turns ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
            FROM piece),
        marked AS (
            SELECT *, CASE WHEN role = 'assistant' THEN
                       CAST(CAST(base + 13 + length(role) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(base + 13 + length(role) + size + 10 AS BIGINT) AS VARCHAR) END AS span
            FROM placed)
        SELECT m.conv_id AS pair_id, CAST(any_value(m.n_prompt_turns) AS INTEGER) AS n_prompt_turns,
               coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k <= n_prompt_turns), '') AS prompt,
               coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k > n_prompt_turns), '') AS chosen,
               coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'r' AND k > n_prompt_turns), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'c' AND k > n_prompt_turns AND span IS NOT NULL), '') AS chosen_mask,
               coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 'r' AND k > n_prompt_turns AND span IS NOT NULL), '') AS rejected_mask
        FROM marked m GROUP BY m.conv_id
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) = 1 AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
        WINDOW w AS (PARTITION BY sha)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
