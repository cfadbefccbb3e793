"""Document fingerprints: a Merkle tree over the sections, paragraphs and pieces of a text.

A text is cut into sections (after blank lines), those into paragraphs (after newlines), and those into leaves: up
to 48 characters, closed by sentence ends or white space. The parts of each level join up to the whole again. A
leaf's digest is the MD5 of its text, an inner node's the MD5 of its children's digests, so equal roots mean equal
texts. The fingerprint holds the root and the labels (eight digits) of the leaves with the shape of the tree:

    root ':' leaf ('.' leaf)* (',' paragraph)* (';' section)*

``likeness`` and ``differing`` work on fingerprints alone: branches that differ locate an edit.

Defined results: null texts are empty and have a root and no leaf. Repeated texts have equal fingerprints. An empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_END, PARAGRAPH_END = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
LEAF = r"[^.!?\n]{1,48}[.!?\s]*|[.!?\s]+"
#: Ids are dealt to ranges by a histogram of so many equal steps at a time; the driver holds about as many counts.
STEPS = 4096


def fingerprint(text: Column) -> Column:
    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x))
        return F.struct(F.md5(F.array_join(leaves, "")).alias("node"), F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, 8)), ".").alias("labels"))

    def section(s: Column) -> Column:
        ps = F.transform(F.split(s, PARAGRAPH_END, -1), paragraph)
        # One pass makes both: a struct is built once for each section.
        return F.struct(F.md5(F.array_join(F.transform(ps, lambda p: p["node"]), "")).alias("node"), F.array_join(F.transform(ps, lambda p: p["labels"]), ",").alias("labels"))

    tree = F.transform(F.split(text, SECTION_END, -1), section)
    root = F.md5(F.array_join(F.transform(tree, lambda s: s["node"]), ""))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(tree, lambda s: s["labels"]), ";"))


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring(fp, 34, F.length(fp)), "[.,;]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots. Else twice the number of shared leaves over the number of leaves of both, held below 1."""
    x, y = leaves(a), leaves(b)
    both, all_ = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    dice = F.when(all_ > 0, 2.0 * both / all_).otherwise(0.0)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), 1.0).otherwise(F.least(dice, 1.0 - 1.0 / (all_ + 1))).cast("double")


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of b, counted through its sections, that a has nowhere."""
    paragraphs = lambda fp: F.split(F.substring(fp, 34, F.length(fp)), "[,;]", -1)
    old = paragraphs(a)
    marked = F.transform(paragraphs(b), lambda p, i: F.when(~F.array_contains(old, p), i))
    return F.filter(marked, lambda x: x.isNotNull())


def boundaries(df: DataFrame, key: str, n: int) -> list[int]:
    """Where at most n ranges of ascending key and nearly equal counts begin, but for the first. An exact count over cells of
    equal width; cells with more than their share of rows are counted anew in finer ones, so outlying keys do no harm.
    The driver holds some STEPS counts."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    cell = lambda shift: F.shiftright(F.col(key).cast("long"), shift)
    shift = max(0, (high - low).bit_length() - STEPS.bit_length() + 1)
    found = df.where(F.col(key).isNotNull()).groupBy(cell(shift).alias("c")).count().collect()
    cells = {r["c"] << shift: r["count"] for r in found}
    most = max(1, sum(cells.values()) // n)
    heavy = {r["c"] for r in found if r["count"] > most}
    while heavy and shift:
        before, shift = shift, max(0, shift - max(1, STEPS.bit_length() - 1 - len(heavy).bit_length()))
        found = df.where(cell(before).isin(sorted(heavy))).groupBy(cell(shift).alias("c")).count().collect()
        for c in heavy:
            del cells[c << before]
        cells |= {r["c"] << shift: r["count"] for r in found}
        heavy = {r["c"] for r in found if r["count"] > most}
    total, run, last, out = sum(cells.values()), 0, 0, []
    for start in sorted(cells):
        at = min(n - 1, run * n // total)
        if at > last:
            out.append(start)
        last, run = max(at, last), run + cells[start]
    return out


def in_ranges(df: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """df with range_id: about n ranges of ascending key; null keys are in range 0. A pure function of the rows, so lost tasks
    and reruns deal alike."""
    starts = boundaries(df, key, n)

    def which(low: int, high: int) -> Column:
        """Of the ranges from low to high, by halving."""
        middle = (low + high + 1) // 2
        return F.lit(low) if low == high else F.when(F.col(key) < starts[middle - 1], which(low, middle - 1)).otherwise(which(middle, high))

    return df.withColumn("range_id", F.when(F.col(key).isNull(), 0).otherwise(which(0, len(starts)))), len(starts) + 1


def with_next(df: DataFrame, key: str, value: str, tie: str, made: Callable[[Column], Column]) -> DataFrame:
    """df with this and next: made(value) of the row and of the one that follows in the order of (key, tie), nulls
    first; the first row's for the last. Each range is sorted by itself; only the first rows of the ranges meet."""
    spark = df.sparkSession
    n = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), STEPS // 4))
    ranged, n = in_ranges(df, key, n)
    order = [F.col(key).asc_nulls_first(), F.col(tie)]
    inside = ranged.withColumn("this", made(F.col(value))).drop(value).withColumn("next", F.lead("this").over(Window.partitionBy("range_id").orderBy(*order)))
    # One row for each of the n ranges: which is first, then its value. n is at most STEPS / 4.
    which = ranged.groupBy("range_id").agg(F.min(F.struct(F.col(key), F.col(tie))).alias("_w")).select(F.col("range_id").alias("_r"), "_w")
    first = ranged.join(F.broadcast(which), (F.col("range_id") == F.col("_r")) & F.col(key).eqNullSafe(F.col(f"_w.{key}")) & (F.col(tie) == F.col(f"_w.{tie}")))
    first = first.dropDuplicates(["range_id"]).select(F.pmod(F.col("range_id") - 1, F.lit(n)).alias("range_id"), made(F.col(value)).alias("_first"))
    return inside.join(F.broadcast(first), "range_id", "left").withColumn("next", F.coalesce("next", "_first")).drop("_first", "range_id")


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last quarter replaced by the next one's beginning, and of the
    next one, with their likeness."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = with_next(rows.withColumn("_tie", F.md5("_text")), id_col, "_text", "_tie", lambda x: F.struct(x.alias("text"), fingerprint(x).alias("fp")))
    text, n = F.col("this.text"), F.length(F.col("this.text"))
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - k), F.substring(F.col("next.text"), F.lit(1), k))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), edited.alias("_edited"), F.col("this.fp").alias("fingerprint"), F.col("next.fp").alias("_next"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    fp = F.col("fingerprint")
    return rows.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(fp, F.col("edited_fingerprint")).alias("near_edited"), likeness(fp, F.col("_next")).alias("near_next"))
