"""Exact line deduplication across documents, in DataFrame functions only (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import carried, few, restored, shuffle_partitions, staged, text_or_empty

#: Keys of this many code points or more count, if this many documents hold them.
MIN_CHARS, MIN_DOCS = 40, 5
#: The commonest keys are decided by a broadcast of this many rows; no other key can hold more than 1/HOT_KEYS of all lines.
HOT_KEYS = 4096
# fixed values: what is stripped from a line, and the letters that are folded
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Which lines of each row stay, as ``(<id_col>, text_hash, drop_runs)`` for the rows that lose any.

    ``drop_runs`` is the complement of the document's keep bitmap, run-length compressed:
    ``array<struct<first: int, n: int>>``, ascending; all other lines are kept.  No text is returned.

    A line's key is the line stripped of ASCII white space with A-Z folded.  Keys of ``min_chars``
    code points found in ``min_docs`` documents lose their lines everywhere but in the largest id.

    1. One pass over the texts writes ``(key hash, id, position)`` of the lines that count (128 bits of hash).
    2. These are range-partitioned by ``(hash, id)`` with a secondary sort by position: a common key
       spreads over as many ranges as it needs.  The first occurrence of a key in a document is
       streamed off; firsts are summed per task before they meet, so a key costs one row a task.
    3. The ``hot_keys`` commonest keys are decided by a broadcast of at most that many rows, the
       others by a join on the hash, where none can hold more than one in ``hot_keys`` of all lines.
    4. Dropped positions are gathered by row and closed up to runs.

    Null and empty texts are one empty line, never dropped.  Rows with the same id are one document
    for counting, so the largest id keeps a line in all of its rows; each row loses lines of its own
    text (``text_hash`` is its 64-bit hash).  A null id never counts nor loses lines.  An empty
    table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    line = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(text)).alias("pos", "line")) \
        .where(F.col("id").isNotNull() & (F.char_length("line") >= min_chars)) \
        .select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = staged(line.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")

    ranged = hashed.repartitionByRange(max(2, shuffle_partitions(spark)), "h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("pos"))
    firsts = ranged.withColumn("nth", first).where("nth = 1")
    common = staged(firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
                    .where(F.col("n_docs") >= min_docs), "common-lines")

    hot = common.orderBy(F.desc("n_docs"), "h1", "h2").limit(hot_keys)  # a bound by construction
    hot = F.broadcast(hot.select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    rest = common.join(hot, ["h1", "h2"], "left_anti").select("h1", "h2", "keeper")
    marked = hashed.join(hot, ["h1", "h2"], "left")
    dropped = marked.where("hot_keeper <> id").select("id", "row", "pos").unionByName(
        marked.where("hot_keeper IS NULL").join(rest, ["h1", "h2"]).where("keeper <> id").select("id", "row", "pos"))

    at = F.col("at")
    gathered = dropped.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
    return gathered.select(F.col("id").alias(id_col), F.col("row").alias("text_hash"), F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n"))).alias("drop_runs"))


def kept_lines(lines: Column, drop_runs: Column) -> Column:
    """The lines outside ``drop_runs``; linear in lines and runs."""
    after = F.concat(F.transform(drop_runs, lambda r: r["first"]), F.array(F.size(lines)))
    return F.flatten(F.transform(after, lambda stop, i: F.when(
        stop > _from(drop_runs, i), F.slice(lines, _from(drop_runs, i) + 1, stop - _from(drop_runs, i))).otherwise(F.array().cast("array<string>"))))


def _from(drop_runs: Column, i: Column) -> Column:
    """Where the i-th kept run starts: after the run dropped before it."""
    before = F.get(drop_runs, i - 1)
    return F.when(i == 0, F.lit(0)).otherwise(before["first"] + before["n"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines gone from ``text_col``, plus ``_n_lines`` (before) and ``_n_dropped``; all rows and columns stay.

    Texts without dropped lines are returned as they are (null stays null).  Columns of the two new
    names are replaced.  Bitmaps are joined by id and hash of the text: broadcast where they are few,
    else built as the hash side, so texts are moved at most once and never sorted.
    """
    marks = staged(bitmaps.select(F.col(id_col).alias("m_id"), F.col("text_hash").alias("m_hash"), F.col("drop_runs").alias("runs")), "drops")
    body = text_or_empty(text_col)
    rows = carried(docs, t_id=F.col(id_col), t_hash=F.xxhash64(body), lines=lines_of(body))
    joined = rows.join(few(marks), (F.col("t_id") == F.col("m_id")) & (F.col("t_hash") == F.col("m_hash")), "left")
    kept = F.when(F.col("runs").isNull(), F.col("_row").getField(text_col)).otherwise(F.array_join(kept_lines(F.col("lines"), F.col("runs")), "\n"))
    n = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["n"]), F.lit(0).cast("long"))
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return restored(joined, [*columns, "_n_lines", "_n_dropped"], **{text_col: kept, "_n_lines": F.size("lines").cast("long"), "_n_dropped": n})
