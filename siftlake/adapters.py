"""Record relations from plain tables, so that every operator can be run and checked without media files.

A document stands for a file: its text is the content, its number of characters the width, codes of its words stand for
perceptual codes (all words: the main code; neighbouring words: the gradient code; quarters and middle: regional codes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import schema as S
from siftlake.functions.codes import simhash, text_codes
from siftlake.storage import settled

TOKEN = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def extension(lang: Column) -> Column:
    return F.when(lang == "en", ".jpg").when(lang == "de", ".gif").when(lang == "fr", ".mp4").when(lang == "es", ".png").otherwise(".bin")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN), lambda x: x != "")


KINDS = tuple(range(7))
#: Kinds 2 to 6, in quarters of the characters.
MIDDLE = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 3)]


def parts(text: Column, kinds: tuple[int, ...] = KINDS) -> Column:
    """kind, tokens of the kinds asked for: 0 all words, 1 neighbouring words, 2 to 5 quarters and 6 the middle half, cut by characters."""
    n = F.length(text)
    words = tokens(text)
    most = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b))
    cut = lambda a, b: tokens(F.substring(text, F.floor(n * a / 4).cast("int") + 1, F.floor(n * b / 4).cast("int") - F.floor(n * a / 4).cast("int")))
    own = lambda k: words if k == 0 else pairs if k == 1 else cut(*MIDDLE[k - 2])
    return F.array(*(F.struct(F.lit(k).alias("kind"), own(k).alias("tokens")) for k in kinds))


def spaced(text: Column) -> Column:
    """The words of tokens in order, with a space between."""
    return F.regexp_replace(F.lower(text), TOKEN, " ")


def document_codes(spark: SparkSession, folder: str, kinds: tuple[int, ...] = KINDS, langs: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, phash, dhash, tiles; null where a part has no words. Only codes of kinds are computed, for documents of langs (none: of
    all); the others are null. Documents without words have no row."""
    docs = table(spark, folder, "documents").where(F.col("lang").isin(*langs) if langs else F.lit(True)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    twice = settled(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "doc-ids-twice", 1)
    if twice.isEmpty():
        wide = row_codes(docs, kinds)
    else:  # rows of one doc_id are one document: what they share counts once
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        wide = row_codes(docs.join(twice, same, "left_anti"), kinds).union(merged_codes(docs.join(twice, same, "left_semi"), kinds))
    whole = F.when(F.greatest(*(F.col(f"t{k}").isNull().cast("int") for k in range(2, 7))) == 0, F.array(*(f"t{k}" for k in range(2, 7))))
    return wide.where(F.coalesce("phash", "dhash", *(f"t{k}" for k in range(2, 7))).isNotNull()).select("doc_id", "phash", "dhash", whole.alias("tiles"))


def row_codes(docs: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """doc_id, phash, dhash, t2 to t6 of each row."""
    n, text = F.length("text"), F.col("text")
    edge = lambda a: F.floor(n * a / 4).cast("int")
    part = {k: F.substring(text, edge(a) + 1, edge(b) - edge(a)) for k, (a, b) in zip(range(2, 7), MIDDLE)}
    name = {0: "phash", 1: "dhash"} | {k: f"t{k}" for k in range(2, 7)}
    cut = docs.select("doc_id", *(spaced(part.get(k, text)).alias(name[k]) for k in kinds))
    coded = text_codes(cut, ["doc_id"], [name[k] for k in kinds if k != 1], [name[k] for k in kinds if k == 1])
    return coded.select("doc_id", *(F.col(c) if k in kinds else F.lit(None).cast("bigint").alias(c) for k, c in name.items()))


def merged_codes(docs: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """row_codes of the rows of each doc_id together."""
    each = docs.select("doc_id", F.explode(parts(F.col("text"), kinds)).alias("p")).groupBy("doc_id", "p.kind").agg(F.flatten(F.collect_list("p.tokens")).alias("tokens"))
    codes = simhash(each, ["doc_id", "kind"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("code")))
    return codes.groupBy("doc_id").agg(of(0).alias("phash"), of(1).alias("dhash"), *(of(k).alias(f"t{k}") for k in range(2, 7)))


def base_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and record columns of documents, without codes; decisions about people come from labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    seconds = 1_600_000_000 + (d * 7919) % 1_000_000
    ext, source = extension(F.col("lang")), F.coalesce("source", F.lit(""))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("/"), source, F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc"), F.lpad(d.cast("string"), 8, "0"), ext).alias("path"),
        F.octet_length(text).cast("bigint").alias("size"),
        (seconds + 0.5).cast("double").alias("mtime"),
        F.when(d % 5 != 0, seconds * 1_000_000_000 + d).cast("bigint").alias("mtime_ns"),
        S.media_type(ext).alias("media_type"),
        ext.alias("extension"),
        F.lit(1).cast("bigint").alias("device"),
        (d - F.when(d % 20 == 1, 1).otherwise(0)).cast("bigint").alias("inode"),
        F.when(d % 17 != 0, F.col("n_chars")).cast("int").alias("width"),
        F.when(d % 17 != 0, 1 + d % 3).cast("int").alias("height"),
        F.sha2(text, 256).alias("sha256"),
        F.sha2(F.substring(text.cast("binary"), 1, 65536), 256).alias("partial_hash"),
        F.when(F.col("toxic") == 1, S.PERSON).when(F.col("toxic") == 0, S.NO_PERSON).otherwise(S.FAILED).alias("human_detection_status"),
        F.concat(F.when(d % 11 == 0, "human-presence-v2").otherwise(S.HUMAN_VERSION), F.lit("|opencv|0.4")).alias("human_detection_signature"),
        F.when(d % 7 != 0, d % 4).cast("int").alias("face_count"),
        F.when(d % 13 == 0, F.concat(F.lit("image hash: fault "), (d % 3).cast("string"))).alias("error"),
        F.concat(F.lit("/"), source).alias("root"),
    )


#: Languages whose documents stand for pictures.
PICTURES = ("en", "de", "es")


def records(spark: SparkSession, folder: str, kinds: tuple[int, ...] = KINDS, langs: tuple[str, ...] = ()) -> DataFrame:
    return base_records(spark, folder).join(document_codes(spark, folder, kinds, langs), "doc_id", "left")


def conversation_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """id, duration (all characters), frames: a code for each turn in order, null where a turn has no words."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    said = turns.groupBy("conv_id", "turn").agg(F.flatten(F.collect_list(tokens(F.col("text")))).alias("tokens"))
    codes = simhash(said, ["conv_id", "turn"])
    whole = turns.groupBy("conv_id", "turn").agg(F.sum(F.length("text")).alias("chars")).join(codes, ["conv_id", "turn"], "left")
    listed = whole.groupBy("conv_id").agg(F.sum("chars").cast("double").alias("duration"), F.array_sort(F.collect_list(F.struct("turn", "code"))).alias("x"), F.count("code").alias("n"), F.count("*").alias("m"))
    frames = F.when(F.col("n") == F.col("m"), F.transform("x", lambda s: s["code"]))
    return listed.select(F.col("conv_id").alias("id"), "duration", frames.alias("frames"))


def sign_codes(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, code: the signs of the first 64 numbers of each embedding."""
    bit = lambda i: F.when(F.element_at("embedding", i + 1) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    code = bit(0)
    for i in range(1, 64):
        code = code.bitwiseOR(bit(i))
    return table(spark, folder, "embeddings").where(F.size("embedding") >= 64).select("vec_id", "label", code.alias("code"))


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as receipts: a view is a preview, its time the start, its value the size of its one item."""
    e = table(spark, folder, "events").withColumn("started_at", F.col("ts").cast("timestamp"))
    ok = F.col("event_type") != "error"
    item = F.struct(F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"), ok.alias("ok"), F.when(F.col("event_type") == "purchase", F.lit("/q")).alias("destination"), F.floor(F.col("value") * 100).cast("bigint").alias("size"))
    return e.select(
        F.format_string("%012d", "event_id").alias("id"), (F.col("event_type") == "view").alias("dry_run"), F.when(F.col("event_type") == "purchase", "quarantine").otherwise("trash").alias("action"),
        "started_at", F.array(item).alias("items"), F.floor(F.col("value") * 100).cast("bigint").alias("receipt_bytes"), F.concat(F.lit("/log/action-"), F.col("event_id").cast("string"), F.lit(".json")).alias("log_path"),
    )


