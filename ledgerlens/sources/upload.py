"""Upload sources (S1, S4): CSV read as text with the usual missing tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import exprs, rules
from ..session import stage

ACCEPTED = (".csv", ".xlsx", ".xls")


class UploadError(ValueError):
    """An upload the ingest refuses (format, parse failure, empty)."""


def breaks_in_values(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may hold a line break, from one distributed pass
    over the lines: some line has a quote that is neither doubled nor one of
    the two around a whole value."""
    # possessive, and no group: long lines need no deep recursion
    left = F.regexp_replace(F.concat(F.lit(","), F.replace("value", F.lit('""'), F.lit("")), F.lit(",")), r',"[^"]*+"(?=,)', ",")
    return bool(spark.read.text(path).agg(F.max(F.contains(left, F.lit('"')))).first()[0])


def _inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line.

    A quote opens a value only at a field's start; a doubled one is a
    character; what follows a closing quote up to the separator is dropped."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            q = line.find('"', at)
            while q >= 0 and line[q + 1:q + 2] == '"':
                q = line.find('"', q + 2)
            if q < 0:
                return True
            at = line.find(",", q + 1) + 1
            if not at:
                return False
            inside = False
        elif line[at:at + 1] == '"':
            at, inside = at + 1, True
        else:
            at = line.find(',"', at) + 1
            if not at:
                return False


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they are in; a task reads a split's lines in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches):
    from itertools import groupby

    rows = ((f, b, v) for batch in batches for f, b, v in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in own)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, first, record``: the records of CSV files, line breaks in
    quoted values included, read by as many tasks as there are splits.

    Whether a line starts a record depends on all lines before it, but only
    through one bit: a quoted value is open or not.  A first pass finds what
    each split makes of either, one row a split; composed in order, these say
    how every split begins.  The second pass cuts records; what a split holds
    of a record begun before it is joined to its beginning afterwards.
    ``first``: a file's first record."""
    import pyarrow as pa

    lines = _split_lines(spark, path)

    def ends(batches):
        for (file, block), own in _by_split(batches):
            out, inn = False, True
            for line in own:
                out, inn = _inside_after(line, out), _inside_after(line, inn)
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "out": [out], "inn": [inn]})

    found = lines.mapInArrow(ends, "file string, block long, out boolean, inn boolean").collect()  # one row a split
    opens, held = {}, (None, False)
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        inside = held[1] if held[0] == r["file"] else False
        opens[r["file"], r["block"]] = inside
        held = (r["file"], r["inn"] if inside else r["out"])

    # part: 0 whole, 1 end of an earlier one, 2 middle, 3 beginning
    schema = "file string, block long, part int, first boolean, record string"
    names = ["file", "block", "part", "first", "record"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def cut(batches):
        rows, size = [], 0
        for (file, block), own in _by_split(batches):
            inside, held, begun, head = opens[file, block], [], not opens[file, block], block == 0
            for line in own:
                held.append(line)
                inside = _inside_after(line, inside)
                if not inside:
                    text = "\n".join(held)
                    if text.strip(" "):  # empty lines are no records
                        rows.append((file, block, 0 if begun else 1, head and begun, text))
                        head = head and not begun
                        size += len(text)
                    elif not begun:
                        rows.append((file, block, 1, False, text))
                    held, begun = [], True
                if size > 1 << 22:
                    yield table(rows)
                    rows, size = [], 0
            if held:
                rows.append((file, block, 3 if begun else 2, head and begun, "\n".join(held)))
        if rows:
            yield table(rows)

    parts = lines.mapInArrow(cut, schema)
    if not any(opens.values()):
        return parts.select("file", "block", "first", "record")
    parts = stage(parts, "csv-records")
    # at most two fragments a split: its end of an earlier record, its beginning of a later one
    order = Window.partitionBy("file").orderBy("block", "part")
    begun = parts.where("part > 0").withColumn("own", F.last(F.when(F.col("part") == 3, F.col("block")), ignorenulls=True).over(order))
    joined = begun.groupBy("file", "own").agg(F.sort_array(F.collect_list(F.struct("block", "part", "record"))).alias("f"),
                                              F.max("first").alias("first"))
    whole = joined.select("file", F.col("own").alias("block"), "first", F.array_join(F.col("f.record"), "\n").alias("record"))
    return parts.where("part = 0").select("file", "block", "first", "record").unionByName(whole)


def read_upload_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Header CSV, every column as text, missing-value tokens -> null.

    Spark's ``nullValue`` takes a single token, so the token set is applied
    afterwards with one ``isin`` per column.  Quotes inside a quoted value
    are doubled, and a quoted value may hold line breaks: where
    :func:`breaks_in_values` finds a sign of it, records are cut by
    :func:`csv_records`, still split by split (``multi_line``: True for
    Spark's own reader of whole files, False for none of it).  Short rows are
    filled with nulls, rows with too many values are an error.
    """
    options = {"quote": '"', "escape": '"'}
    extra = "_corrupt_record"
    if multi_line is None and breaks_in_values(spark, path):
        header = _first_record(spark, path)
        names = spark.read.options(header=True, **options).csv(spark.sparkContext.parallelize([header])).columns
        schema = ", ".join(f"{exprs.sql_ident(c)} STRING" for c in names)
        body = csv_records(spark, path).where("NOT first")  # a file's first record is its header
        raw = body.select(F.from_csv("record", f"{schema}, {extra} STRING",
                                     {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": extra}).alias("r")).select("r.*")
    else:
        read = spark.read.option("header", True).option("inferSchema", False).options(**options).option("multiLine", bool(multi_line))
        names = read.csv(path).columns
        schema = ", ".join(f"{exprs.sql_ident(c)} STRING" for c in names)
        raw = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", extra).schema(
            f"{schema}, {extra} STRING").csv(path)
    # a short row is reported as corrupt too: only more separators than columns are an error
    return _refuse_long(raw, names, extra).select(*[F.when(~F.col(f"`{c}`").isin(*rules.CSV_NA_TOKENS), F.col(f"`{c}`")).alias(c)
                        for c in names])


def _first_record(spark: SparkSession, path: str) -> str:
    """The first record of the first file: a few lines from its start."""
    out, inside, take = [], False, 8
    while True:
        lines = [r[0] for r in spark.read.text(path).where("_metadata.file_block_start = 0").limit(take).collect()]
        out, inside = [], False
        for line in lines:
            if not out and not line.strip():
                continue
            out.append(line)
            inside = _inside_after(line, inside)
            if not inside:
                return "\n".join(out)
        if len(lines) < take:
            return "\n".join(out)
        take *= 8


def _refuse_long(raw: DataFrame, names: list[str], extra: str) -> DataFrame:
    """Fail on records with more values than the header: Spark fills every
    column of those, while a short record leaves the last one empty."""
    last = F.col(exprs.sql_ident(names[-1]))
    quoted = F.regexp_replace(F.col(extra), r'"(?:[^"]|"")*"', "")
    long = F.col(extra).isNotNull() & (F.length(quoted) - F.length(F.translate(quoted, ",", "")) >= len(names))
    checked = F.when(long, F.raise_error(F.concat(F.lit("too many values: "), F.col(extra))).cast("string")).otherwise(last)
    return raw.withColumn(names[-1], checked)


def check_upload(spark: SparkSession, name: str, path: str, multi_line: bool | None = None) -> DataFrame:
    """Refuse unsupported extensions, unreadable and empty uploads.

    Excel workbooks are refused with a hint: there is no Excel reader in
    this Spark setup (convert to CSV or Parquet first).
    """
    low = name.lower()
    if not low.endswith(ACCEPTED):
        raise UploadError("Invalid file format. Only CSV and Excel files are supported.")
    if not low.endswith(".csv"):
        raise UploadError("Excel uploads must be converted to CSV or Parquet first.")
    try:
        df = read_upload_csv(spark, path, multi_line)
        header = df.columns
        if any(("\x00" in c) or ("�" in c) for c in header):
            raise UploadError("Could not parse uploaded file: binary content")
        empty = df.isEmpty()
    except UploadError:
        raise
    except Exception as e:  # parse failures surface as Spark errors
        raise UploadError(f"Could not parse uploaded file: {type(e).__name__}") from e
    if empty or not header:
        raise UploadError("The uploaded file is empty.")
    return df
