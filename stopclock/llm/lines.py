"""Line deduplication by overlapping windows of three lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, stored

BLANK = " \t\r\x0b\x0c"


def remove_repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, kept: every document without the lines of repeated windows.

    Lines are parted by line feeds; white space around a line does not count, and lines of nothing else are passed
    over. A window is `size` consecutive lines of one document. Of windows with equal lines the first occurrence, by
    doc_id and then place, stays; every line that a later occurrence covers goes, also where it overlaps the first.
    `kept` joins the remaining lines, as they were, by line feeds; a text with nothing removed is kept unchanged.
    Windows are equal if their 64 and 32 bit hashes are.

    Null texts have no lines and stay null; texts of fewer than `size` lines are kept. Rows without a doc_id are
    kept and are no reference. Rows that repeat a doc_id are one document (`one_per_document`). Further columns are
    ignored.
    """
    docs = one_per_document(docs, "text")
    bare = lambda x: F.btrim(x, F.lit(BLANK))
    lines = F.filter(F.split("text", "\n"), lambda x: bare(x) != "")
    named = docs.where("doc_id is not null and text is not null").select("doc_id", F.transform(lines, bare).alias("lines"))
    cells = ", ".join(f"lines[i + {k}]" for k in range(size))
    marks = F.expr(f"transform(sequence(0, size(lines) - {size}), i -> struct(i as start, xxhash64({cells}) as mark, hash({cells}) as check))")
    windows = named.where(F.size("lines") >= size).select("doc_id", F.explode(marks).alias("w")).select("doc_id", "w.start", "w.mark", "w.check")
    firsts = windows.groupBy("mark", "check").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts.select("mark", "check", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start")), "repeated")
    later = windows.join(firsts, ["mark", "check"]).where("doc_id <> first_doc or start <> first_start")
    starts = later.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))

    joined = docs.join(starts, "doc_id", "left").withColumn("lines", lines)
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    joined = joined.withColumn("gone", gone)
    left = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept"),
    )
