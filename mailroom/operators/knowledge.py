"""Knowledge base: ingest, chunking, listing, deletion, term vectors
(S3, S4, C2, A12, A14, K4, P4, T1, T2, C3).

The chunk table is the source of truth; the search index (postings) is
derived from it, so deleted chunks can never be returned by search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_split_words, py_strip, tokens
from ..plans.sizing import TERM_BYTES, fanout_partitions

# Fixed values of the chunker.
CHUNK_WORDS = 800
CHUNK_OVERLAP = 50
DEFAULT_DEPARTMENT = "general"
DEFAULT_TEXT_NAME = "Manual Entry"
TEXT_FILE_TYPE = "text"
# File types by extension (own choice; uploads carry no MIME type here).
FILE_TYPES = {"txt": "text/plain", "html": "text/html", "htm": "text/html",
              "md": "text/markdown", "csv": "text/csv", "json": "application/json"}

CHUNK_KEY = ["upload_id", "chunk_index"]


def chunk(sources: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """kb_sources(upload_id, name, file_type, department, content, created_at)
    -> one row per chunk: ``size`` words starting every ``size - overlap``
    words, joined by one space, with a deterministic id. No words, no
    chunks; a tail window lying inside the previous one is kept.

    Row-local (no shuffle). The word array is computed once per document;
    the generator then emits one row per window start and each chunk is a
    slice of that array.
    """
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap")
    step = size - overlap
    keep = ["upload_id", "name", "file_type", "department", "created_at"]
    w = sources.select(*keep, py_split_words(F.coalesce(F.col("content"), F.lit(""))).alias("_w"))
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    g = w.select(*keep, "_w", F.posexplode(starts).alias("chunk_index", "_start"))
    return g.select(
        F.concat_ws("-", F.col("upload_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"),
        "upload_id", "name", "file_type",
        F.array_join(F.slice("_w", F.col("_start") + 1, F.lit(size)), " ").alias("content"),
        F.col("chunk_index").cast("int").alias("chunk_index"), "department", "created_at")


def read_files(spark, path: str, glob: str | None = None) -> DataFrame:
    """Uploaded files as (path, content binary), via the binaryFile source."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "content")


def kb_ingest_files(files: DataFrame, department: str = DEFAULT_DEPARTMENT):
    """(path, content binary[, upload_id, created_at]) -> (accepted, rejected).

    Bytes are decoded as UTF-8 with replacement. Rejected, with a reason in a
    side output: a PDF (by name or by its first bytes; its text needs an
    extractor, and its bytes are no text), and a file of whitespace only.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    ftype = F.lit(None).cast("string")
    for e, t in FILE_TYPES.items():
        ftype = F.when(ext == e, F.lit(t)).otherwise(ftype)
    df = files.select(
        *[c for c in ("upload_id", "created_at") if c in files.columns],
        name.alias("name"),
        F.coalesce(ftype, F.lit("application/octet-stream")).alias("file_type"),
        F.lit(department).alias("department"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        (F.coalesce(ext == "pdf", F.lit(False)) | F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False))).alias("_pdf"))
    text = F.coalesce(py_strip(F.col("content")) != "", F.lit(False))
    rejected = df.filter(F.col("_pdf") | ~text)
    return (df.filter(~F.col("_pdf") & text).drop("_pdf"),
            rejected.withColumn("reason", F.when(F.col("_pdf"), "pdf").otherwise("no text")).drop("_pdf"))


def kb_ingest_text(rows: DataFrame):
    """(name?, content?, department?[, upload_id, created_at]) -> (accepted,
    rejected). Defaults fill missing fields; only an empty or missing content
    is rejected (whitespace-only passes and yields no chunks)."""
    cols = rows.columns
    df = rows.select(
        *[c for c in ("upload_id", "created_at") if c in cols],
        F.coalesce(F.col("name") if "name" in cols else F.lit(None), F.lit(DEFAULT_TEXT_NAME)).alias("name"),
        F.lit(TEXT_FILE_TYPE).alias("file_type"),
        F.coalesce(F.col("department") if "department" in cols else F.lit(None),
                   F.lit(DEFAULT_DEPARTMENT)).alias("department"),
        F.col("content").alias("content"))
    ok = F.coalesce(F.col("content"), F.lit("")) != ""
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit("content is required"))


def chunks_per_upload(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("upload_id", "name").agg(F.count(F.lit(1)).alias("chunks"))


def kb_metadata(chunks: DataFrame) -> DataFrame:
    """Listing columns only; Catalyst prunes ``content`` from the scan."""
    return chunks.select("id", "name", "file_type", "department", "created_at", "chunk_index")


def kb_list(chunks: DataFrame) -> DataFrame:
    """One row per document name: the newest chunk row's fields and the
    chunk count. Ties on time go to the earliest upload, then the lowest
    chunk index. A partial aggregate (min_by), so a name with very many
    chunks is combined map-side before the shuffle."""
    order = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")) * -1,
                     F.col("upload_id"), F.col("chunk_index"))
    best = F.min_by(F.struct("id", "file_type", "department", "created_at"), order)
    return (chunks.groupBy("name").agg(best.alias("b"), F.count(F.lit(1)).alias("chunks"))
            .select("name", "b.id", "b.file_type", "b.department", "b.created_at", "chunks"))


def kb_delete(chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    """Remaining chunks after removing every chunk whose name is listed."""
    return chunks.join(deletions.select("name").distinct(), "name", "left_anti")


# ---------------------------------------------------------------- term vectors

def term_vectors(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Long-format count vectors: (keys..., tok, n, n2), n2 = squared norm of
    the row's count vector. Empty text -> no rows.

    When ``df`` is hash-partitioned by ``keys`` (see ``kb_index``) the count
    and the norm are computed in the same tasks, with no exchange.
    """
    ex = df.select(*keys, F.explode(tokens(F.col(text))).alias("tok"))
    tc = ex.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n"))
    return tc.withColumn("n2", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))


def tokenize(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Token count and the tokens themselves (space-joined) per row."""
    t = tokens(F.col(text))
    return df.select(*keys, F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def term_freq(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(keys..., tok, n, tf): count over total tokens of the row (no idf)."""
    tv = term_vectors(df, keys, text)
    total = F.sum("n").over(Window.partitionBy(*keys))
    return tv.select(*keys, "tok", "n", (F.col("n") / total).alias("tf"))


def kb_index(chunks: DataFrame) -> DataFrame:
    """Postings of the chunk table, hash-partitioned by chunk key.

    The partitioning is what later lets the similarity join aggregate pair
    scores without shuffling pairs: every posting of a chunk lives in one
    partition. Partitioning by the full chunk key (not the upload) keeps one
    huge upload from landing in one task.
    """
    n = fanout_partitions(chunks, TERM_BYTES)
    parted = chunks.select(*CHUNK_KEY, "content").repartition(n, *CHUNK_KEY)
    return term_vectors(parted, CHUNK_KEY, "content")
