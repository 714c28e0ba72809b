"""From files to documents and chunks: deduplication, chunking, page text, batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import vocab as V
from evidara.functions.ordering import position, running_total
from evidara.functions.text import base_name, clean_text, col, document_type, file_stem, squeeze


# -- content-hash deduplication -----------------------------------------------
def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def classify_uploads(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Status of every upload: failed, duplicate (of a stored or an earlier file) or uploaded.

    ``uploads`` needs workspace_id, ord, filename, content_hash, reject_reason; ``stored``
    needs workspace_id, id, filename, content_hash.  The first holder of a hash comes
    from a map-side combined minimum, so one hash shared by a third of all files does
    not meet in one task; only keys are shuffled.
    """
    keys = ["workspace_id", "content_hash"]
    good = uploads.where(F.col("reject_reason").isNull())
    holders = good.groupBy(*keys).agg(
        F.min_by(F.struct("ord", "filename"), "ord").alias("first_upload")
    )
    if stored is not None:
        kept = (
            stored.where(F.coalesce(F.col("content_hash"), F.lit("")) != "")
            .groupBy(*keys)
            .agg(F.min_by(F.struct("id", "filename"), "id").alias("stored"))
        )
        holders = holders.join(kept, keys, "left")
    else:
        holders = holders.withColumn("stored", F.lit(None).cast("struct<id:bigint,filename:string>"))
    joined = uploads.join(holders, keys, "left")
    rejected = F.col("reject_reason").isNotNull()
    is_first = F.col("ord") == F.col("first_upload.ord")
    repeated = F.col("stored").isNotNull() | ~is_first
    status = F.when(rejected, "failed").when(repeated, "duplicate").otherwise("uploaded")
    return (
        joined.withColumn("status", status)
        .withColumn(
            "stored_filename",
            F.when(~rejected, F.coalesce("stored.filename", "first_upload.filename")),
        )
        .withColumn("stored_id", F.when(~rejected, F.coalesce(F.col("stored.id"), F.col("first_upload.ord"))))
        .withColumn(
            "message",
            F.when(rejected, F.col("reject_reason"))
            .when(repeated, "Exact file content is already in the workspace.")
            .otherwise("Document parsed and indexed."),
        )
        .drop("stored", "first_upload")
    )


def outcome_summary(statuses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return statuses.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "uploaded").alias("uploaded_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
    )


def unique_names(files: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Stored name per file: the first keeps its name, later ones get ``-2``, ``-3`` ...

    A deterministic suffix replaces the reference's time stamp.
    """
    numbered = position(files, [*keys, "filename"], [F.col(order)], "_copy")
    stem = file_stem("filename")
    suffix = F.substring(F.col("filename"), F.length(stem) + 1, F.length("filename"))
    renamed = F.concat(stem, F.lit("-"), F.col("_copy").cast("string"), suffix)
    return numbered.withColumn(
        "stored_filename", F.when(F.col("_copy") == 1, F.col("filename")).otherwise(renamed)
    ).drop("_copy")


def document_rows(parsed: DataFrame) -> DataFrame:
    """Catalogue rows of parsed files (``parse_files`` output joined to upload columns)."""
    return parsed.where(F.col("error").isNull()).select(
        "workspace_id",
        F.col("ord").alias("id"),
        "filename",
        document_type("filename").alias("document_type"),
        "upload_time",
        F.col("text").alias("parsed_text"),
        "page_count",
        "parser",
        "ocr_used",
        "ocr_engine",
        "ocr_confidence",
        "extracted_tables_count",
        "extracted_images_count",
        "extraction_warnings",
        "content_hash",
        "size_bytes",
    )


# -- chunking -----------------------------------------------------------------
def chunk_pages(
    pages: DataFrame,
    keys: Sequence[str] = ("workspace_id", "document_id"),
    size: int = V.CHUNK_WORDS,
    overlap: int = V.CHUNK_OVERLAP,
    page: str = "page",
    text: str = "text",
    window: str | None = None,
) -> DataFrame:
    """Overlapping word windows per page; ``chunk_index`` runs on across the pages of a document.

    ``window`` names a column for the number of the window in its page, for ``window_text``.

    A page's windows follow from its word count, so its first chunk index is a running
    total over pages (in bounded blocks of pages) and the windows are sliced in place.
    """
    step = max(size - overlap, 1)
    # Words are counted by their blanks; an array of them is only made where windows are cut.
    count = F.when(F.col("_text") == "", 0).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit(" "))) + 1)
    windows = F.when(count == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((count - size) / step) + 1))
    # The text travels as one string, which is a third of its words as an array.
    counted = pages.withColumn("_text", squeeze(text)).withColumn("_windows", windows.cast("bigint"))
    numbered = running_total(counted.drop(text), keys, page, "_windows", "_first").where(F.col("_windows") > 0)
    exploded = numbered.withColumn("_words", F.split("_text", " ")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_windows") - 1))
    )
    kept = [c for c in pages.columns if c not in (*keys, page, text)]
    return exploded.select(
        *keys,
        page,
        *kept,
        (F.col("_first") + F.col("_i")).alias("chunk_index"),
        *([F.col("_i").alias(window)] if window else []),
        F.array_join(F.slice("_words", (F.col("_i") * step + 1).cast("int"), F.lit(size)), " ").alias("text"),
    )


def window_text(text: Column | str, window: Column | str, size: int, overlap: int) -> Column:
    """The text of one window of a page, as ``chunk_pages`` cuts it."""
    first = (col(window) * max(size - overlap, 1) + 1).cast("int")
    return F.array_join(F.slice(F.split(squeeze(text), " "), first, F.lit(size)), " ")


# -- page text ----------------------------------------------------------------
def source_pages(chunks: DataFrame, keys: Sequence[str] = ("workspace_id", "filename", "page"), order: str = "id") -> DataFrame:
    """Page text for validation: distinct chunk texts of a page in first-seen order.

    Copies of a chunk collapse in a combined minimum before a page's texts meet.
    """
    distinct = (
        chunks.withColumn("text", clean_text("text"))
        .where(F.col("text") != "")
        .groupBy(*keys, "text")
        .agg(F.min(order).alias("_ord"))
    )
    parts = F.array_sort(F.collect_list(F.struct("_ord", "text")))
    return distinct.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


# -- greedy packing -----------------------------------------------------------
def evidence_block(filename: Column | str = "filename", page: Column | str = "page", text: Column | str = "text") -> Column:
    return F.concat(
        F.lit("Source: "), col(filename), F.lit("\nPage: "), col(page).cast("string"), F.lit("\nText:\n"), col(text)
    )


def evidence_batches(
    chunks: DataFrame,
    keys: Sequence[str] = ("workspace_id",),
    order: str = "id",
    limit: int = V.BATCH_CHARACTERS,
    segment: int = 50_000,
) -> DataFrame:
    """Number the greedy batches of a workspace: a batch closes before it would exceed ``limit``.

    Greedy packing is one sequential chain per workspace, but only block lengths decide
    it.  The chain is cut into segments of ``segment`` blocks: every segment reports, for
    each possible open length at its entry, the open length at its exit and the batches
    it closes (a short step function); composing those gives every segment its entry
    state, and the segments are numbered independently.  No task sees more than one
    segment's lengths or one workspace's step functions, and no text is shuffled to Python.
    """
    keys = list(keys)
    limit = min(max(limit, V.BATCH_CHARACTERS_MIN), V.BATCH_CHARACTERS_MAX)
    lengths = chunks.select(*keys, F.col(order).alias("_ord"), F.length(evidence_block()).alias("_len"))
    placed = position(lengths, keys, [F.col("_ord")], "_pos")
    placed = placed.withColumn("_segment", F.floor((F.col("_pos") - 1) / segment))
    key_ddl = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _with_key(keys, key, _segment_steps(_ordered_lengths(pdf), limit), {"_segment": key[len(keys)]})

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _with_key(keys, key, _segment_entries(pdf))

    def number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        marks = _assign(pdf["_len"].to_numpy(), int(pdf["_entry"].iloc[0]), int(pdf["_batch"].iloc[0]), limit)
        return _with_key(keys, key, pd.DataFrame({"_ord": pdf["_ord"].to_numpy(), "batch": marks}))

    step_ddl = f"{key_ddl}, _segment bigint, low bigint, high bigint, exit bigint, closed bigint"
    functions = placed.groupBy(*keys, "_segment").applyInPandas(steps, step_ddl)
    states = functions.groupBy(*keys).applyInPandas(entries, f"{key_ddl}, _segment bigint, _entry bigint, _batch bigint")
    numbered = (
        placed.join(states, [*keys, "_segment"])
        .groupBy(*keys, "_segment")
        .applyInPandas(number, f"{key_ddl}, _ord {chunks.schema[order].dataType.simpleString()}, batch bigint")
    )
    return chunks.join(numbered.withColumnRenamed("_ord", order), [*keys, order])


def batch_texts(numbered: DataFrame, keys: Sequence[str] = ("workspace_id",), order: str = "id") -> DataFrame:
    """Prompt text per batch; a batch holds at most ``limit`` characters or one oversize block."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), evidence_block().alias("b"))))
    return (
        numbered.groupBy(*keys, "batch")
        .agg(F.count("*").alias("blocks"), F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("text"))
        .withColumn("characters", F.length("text"))
    )


def _with_key(keys: list[str], key: tuple, frame: pd.DataFrame, extra: dict | None = None) -> pd.DataFrame:
    front = pd.DataFrame({k: [v] * len(frame) for k, v in zip(keys, key)} | {k: [v] * len(frame) for k, v in (extra or {}).items()})
    return pd.concat([front, frame.reset_index(drop=True)], axis=1)


def _ordered_lengths(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.sort_values("_pos")["_len"].to_numpy(dtype="int64")


def _segment_steps(lengths: np.ndarray, limit: int) -> pd.DataFrame:
    """Rows (low, high]: an open length in that range at entry leads to (exit, closed)."""
    ahead = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    # First block that no longer fits a batch opened at block i.
    following = np.maximum(np.searchsorted(ahead, ahead[:-1] + limit, side="right") - 1, np.arange(n) + 1)
    leave, closed = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
    for i in range(n - 1, -1, -1):
        after = following[i]
        if after >= n:
            leave[i] = ahead[n] - ahead[i]
        else:
            leave[i], closed[i] = leave[after], closed[after] + 1
    rows = [(-1, 0, leave[0], closed[0])]
    top = 2**62
    for i in range(n):
        low = max(limit - ahead[i + 1], 0)
        if low < top:
            rows.append((low, top, leave[i], closed[i] + 1))
        top = low
        if top == 0:
            break
    if top > 0:
        rows.append((0, top, None, 0))
    table = pd.DataFrame(rows, columns=["low", "high", "exit", "closed"])
    # An open batch that survives the whole segment grows by the segment's length.
    table["exit"] = table["exit"].fillna(-int(ahead[n])).astype("int64")
    return _merge_steps(table)


def _merge_steps(table: pd.DataFrame) -> pd.DataFrame:
    """Join neighbouring ranges that lead to the same state."""
    head, rest = table.iloc[:1], table.iloc[1:]
    change = (rest["exit"].diff() != 0) | (rest["closed"].diff() != 0)
    merged = rest.groupby(change.cumsum()).agg({"low": "min", "high": "max", "exit": "first", "closed": "first"})
    return pd.concat([head, merged], ignore_index=True)


def _segment_entries(steps: pd.DataFrame) -> pd.DataFrame:
    """Compose the step functions of a workspace in segment order."""
    rows, length, batch = [], 0, 0
    for segment, table in steps.sort_values("_segment").groupby("_segment", sort=True):
        rows.append((segment, length, batch))
        hit = table[(table["low"] < length) & (length <= table["high"])].iloc[0]
        batch += int(hit["closed"])
        leaves = int(hit["exit"])
        length = length - leaves if leaves < 0 else leaves
    return pd.DataFrame(rows, columns=["_segment", "_entry", "_batch"])


def _assign(lengths: np.ndarray, open_length: int, batch: int, limit: int) -> np.ndarray:
    marks = np.empty(len(lengths), dtype="int64")
    for i, size in enumerate(lengths):
        if open_length and open_length + size > limit:
            batch += 1
            open_length = 0
        open_length += int(size)
        marks[i] = batch
    return marks
