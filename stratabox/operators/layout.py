"""Byte layout of archives as intervals: regions, gaps, overlaps, compaction offsets, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratabox.sources import format as fmt
from stratabox.sources.archive import view

# One letter for each kind of region.
GLYPHS = {"header": "H", "tableheader": "T", "entries": "E", "data": "D", "slack": "_", "gap": "."}


def regions(archives: DataFrame) -> DataFrame:
    """path, start, len, end, kind, label, uid, file_len: header, block headers, entry arrays, data and slack, by one walk of each file."""
    return view(archives, "regions")


def with_cover(found: DataFrame) -> DataFrame:
    """Adds covered: the farthest end among the regions before, in order of start and length."""
    before = Window.partitionBy("path").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))


def gaps(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, start, len of what no region covers, the end of the file included."""
    inner = with_cover(found).filter("start > covered").select("path", F.col("covered").alias("start"), (F.col("start") - F.col("covered")).alias("len"))
    ends = found.groupBy("path").agg(F.max("end").alias("covered"))
    tail = ends.join(files.select("path", "file_len"), "path").filter("file_len > covered").select("path", F.col("covered").alias("start"), (F.col("file_len") - F.col("covered")).alias("len"))
    return inner.unionByName(tail)


def overlaps(found: DataFrame) -> DataFrame:
    """path, start, len of regions that begin before what lies before them ends."""
    return with_cover(found).filter("start < covered and len > 0").select("path", "start", F.least(F.col("covered") - F.col("start"), F.col("len")).alias("len"))


def layout(archives: DataFrame) -> DataFrame:
    """Regions and gaps together: one walk of each file and one window, which tells of each region the gap before it, and of a file's last
    one the gap behind it."""
    own = Window.partitionBy("path").orderBy("start", "len")
    found = regions(archives)
    covered = F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("start").over(own).isNull()
    told = found.withColumns({"covered": covered, "reached": reached, "last": last})
    none, columns = F.lit(None), ["start", "len", "kind", "label", "uid", "end"]
    hole = lambda low, high: F.struct(low.alias("start"), (high - low).alias("len"), F.lit("gap").alias("kind"), none.cast("string").alias("label"), none.cast("binary").alias("uid"), high.alias("end"))
    pieces = F.array(F.struct(*columns), F.when(F.col("start") > F.col("covered"), hole(F.col("covered"), F.col("start"))), F.when(F.col("last") & (F.col("file_len") > F.col("reached")), hole(F.col("reached"), F.col("file_len"))))
    return told.select("path", "file_len", F.inline(F.filter(pieces, lambda x: x.isNotNull()))).select("path", *columns, "file_len")


def layout_diagnostics(archives: DataFrame) -> DataFrame:
    """The walk's findings, gaps (INFO) and overlaps (WARN)."""
    found = regions(archives)
    detail = F.create_map(F.lit("start"), F.col("start").cast("string"), F.lit("len"), F.col("len").cast("string"))
    told = lambda df, severity, kind: df.select("path", F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.format_string("%d bytes at %d", "len", "start").alias("message"), detail.alias("detail"))
    return view(archives, "diagnostics").unionByName(told(gaps(found, view(archives, "files")), "INFO", "Gap")).unionByName(told(overlaps(found), "WARN", "Overlap"))


def compaction_offsets(partitions: DataFrame) -> DataFrame:
    """Where each partition lands when its archive is compacted: path, ord, uid, block, start."""
    chain = Window.partitionBy("path").orderBy("ord")
    whole = Window.partitionBy("path")
    count = F.count("*").over(whole)
    table = fmt.HEADER + F.greatest(F.ceil(count / fmt.BLOCK_ENTRIES), F.lit(1)) * fmt.BLOCK + count * fmt.ENTRY
    before = F.coalesce(F.sum("used_bytes").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return partitions.select("path", "ord", "uid", F.floor(F.col("ord") / fmt.BLOCK_ENTRIES).cast("int").alias("block"), (table + before).cast("long").alias("start"), "used_bytes")


def glyph(kind: Column) -> Column:
    column = F.lit("?")
    for name, letter in GLYPHS.items():
        column = F.when(kind == name, letter).otherwise(column)
    return column


def strips(found: DataFrame, files: DataFrame, width: int = 64) -> DataFrame:
    """path, strip: the file in `width` cells, each showing the last region that touches it."""
    sized = found.join(files.select("path", "file_len"), "path").filter("file_len > 0 and len > 0")
    cells = sized.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") * width / F.col("file_len")), F.least(F.lit(width - 1), F.floor((F.col("end") - 1) * width / F.col("file_len"))))))
    top = cells.groupBy("path", "cell").agg(F.max_by(glyph(F.col("kind")), F.struct("start", "len")).alias("letter"))
    at = F.aggregate(F.sort_array(F.collect_list(F.struct("cell", "letter"))), F.rpad(F.lit(""), width, "."), lambda s, x: F.overlay(s, x["letter"], x["cell"] + 1, F.lit(1)))
    return top.groupBy("path").agg(at.alias("strip"))


def layout_text(found: DataFrame) -> DataFrame:
    """path, kind, start, line: one fixed-width line for each region."""
    return found.select("path", "kind", "start", F.format_string("%10d  %10d  %-12s %s", "start", "end", "kind", F.coalesce("label", F.lit(""))).alias("line"))


def hexdump(data: DataFrame, most: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, uid, `keep`, offset, line: sixteen bytes a line, a gap after eight, printable characters beside them. With `most`, so many bytes of
    a partition and a line that tells how many more there are."""
    shown_bytes = F.col("data") if most is None else F.substring("data", 1, most)
    rows = data.select("path", "uid", *keep, shown_bytes.alias("d"), F.octet_length("data").alias("size")).filter(F.octet_length("d") > 0)
    pieces = rows.withColumn("offset", F.explode(F.expr("sequence(0, octet_length(d) - 1, 16)"))).withColumn("piece", F.expr("substring(d, offset + 1, 16)"))
    pairs = lambda x: F.trim(F.regexp_replace(F.lower(F.hex(x)), "(..)", "$1 "))
    text = F.concat(F.rpad(pairs(F.substring("piece", 1, 8)), 23, " "), F.lit("  "), F.rpad(pairs(F.expr("substring(piece, 9)")), 23, " "))
    shown = F.regexp_replace(F.decode("piece", "ISO-8859-1"), r"(?s)[^\x20-\x7e]", ".")
    out = pieces.select("path", "uid", *keep, "offset", F.format_string("%08x  %s  |%s|", "offset", text, shown).alias("line"))
    if most is None:
        return out
    more = rows.filter(F.col("size") > most).select("path", "uid", *keep, F.lit(most).alias("offset"), F.format_string("... %d more bytes", F.col("size") - most).alias("line"))
    return out.unionByName(more)
