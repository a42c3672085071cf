"""Line deduplication across documents, with SQL functions only.

Lines become (hash, document, position). They are range-partitioned by hash with a secondary sort by
document and position; a streaming window sees the holders of a line one after the other and keeps
the first of them. What comes back per document is a bitmap of dropped lines, not text.

* A hot line (say in a third of all rows) is spread over ``SALTS`` sub-ranges first. Each of them
  hands on at most ``min_docs`` holders, so the second stream over a key is short.
* Bitmaps are sparse: a map from word number (position div 64) to 64 bits, only of words in which a
  line goes.
* Line keys are told apart by two independent 64-bit hashes.

Defined cases: a null or empty text is one empty line and stays as it is; a null doc_id counts as one
document that is smaller than any other; rows that repeat a doc_id are one document for the counts,
and each row keeps its own bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dischargelab.llm.common import LOWER, SPACE, UPPER, ascii_lower, slim
from dischargelab.session import materialize, shuffle_width

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(texts: DataFrame, min_chars: int) -> DataFrame:
    lines = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper): keys in at least ``min_docs`` documents, with the largest doc_id."""
    n = shuffle_width(lines.sparkSession)
    newest = F.col("doc_id").desc_nulls_last()
    salted = lines.select("h1", "h2", "doc_id", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    part = Window.partitionBy("h1", "h2", "salt").orderBy(newest, "pos")
    holders = (
        salted.repartitionByRange(n, "h1", "h2", "salt")
        .withColumn("first", F.row_number().over(part) == 1)
        .withColumn("fresh", F.col("first") | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(part)))
        .where("fresh")
        .withColumn("nth", F.row_number().over(part))
        .where(F.col("nth") <= min_docs)
        .select("h1", "h2", "doc_id")
    )
    whole = Window.partitionBy("h1", "h2").orderBy(newest)
    return (
        holders.repartitionByRange(n, "h1", "h2")
        .select("h1", "h2", F.row_number().over(whole).alias("nth"), F.first("doc_id").over(whole).alias("keeper"))
        .where(F.col("nth") == min_docs)
        .select("h1", "h2", "keeper")
    )


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    whole = slim(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.withColumn("text_hash", F.xxhash64("text"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, drops map<int,long>, n_dropped) of the rows that lose a line."""
    lines = materialize(_lines(_identified(docs, id_col, text_col), min_chars))
    gone = lines.join(_repeated(lines, min_docs), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 AS int))")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


KEPT = ("array_join(filter(split(text, '\n', -1), (line, i) -> "
        "(shiftright(coalesce(drops[cast(i div 64 AS int)], 0L), cast(i % 64 AS int)) & 1L) = 0), '\n')")


def _with_drops(texts: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that lose no line have a null in ``drops``; bitmaps are the small side, so texts aren't sorted."""
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "drops", "n_dropped")
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).eqNullSafe(F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return texts.join(drops.hint("shuffle_hash"), same, "left")


def _kept(text_col: str) -> Column:
    return F.when(F.col("drops").isNull(), F.col(text_col)).otherwise(F.expr(KEPT.replace("split(text,", f"split(`{text_col}`,")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: doc_id, text without its dropped lines, n_lines before, n_dropped."""
    texts = _identified(docs, id_col, text_col).drop("text_hash")
    return _with_drops(texts, line_bitmaps(docs, id_col, text_col, min_chars, min_docs), "doc_id", "text").select(
        "doc_id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        _kept("text").alias("text"),
    )


def replace_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """The same rows and columns; texts without their dropped lines."""
    cols = [f"_c{i}" for i in range(len(docs.columns))]  # no name of the table can clash
    ids, texts = (cols[docs.columns.index(c)] for c in (id_col, text_col))
    joined = _with_drops(docs.toDF(*cols), line_bitmaps(docs, id_col, text_col, min_chars, min_docs), ids, texts)
    return joined.withColumn(texts, _kept(texts)).select(*[F.col(c).alias(name) for c, name in zip(cols, docs.columns, strict=True)])


def op2(spark, sf_dir: str) -> DataFrame:
    from dischargelab.llm.common import table

    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (r.key IS NULL OR r.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key
GROUP BY k.doc_id
"""
