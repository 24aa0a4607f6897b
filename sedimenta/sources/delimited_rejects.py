"""Delimited members with quoting: loadable rows on one side, rejects with a reason on the other.

Each physical line after a member's header is judged alone. Lines are grouped by layout (delimiter and
column order, from the header), screened for broken quoting, and parsed with ``pyarrow.csv`` whose
invalid-row callback reports wrong field counts; fields are read as strings, and whole cell vectors
are then checked by the type their column demands.

Causes, the first that holds: ``quoting`` (a quoted field is not closed, or more than a delimiter or the end
follows its closing quote), ``columns`` (the field count is not the header's), ``value`` (a cell that
its column cannot hold). A loadable row has a null cause.

Defined results: a null line and a line of white space only are no rows; one carriage return at the end and a
leading byte-order mark are no data; further carriage returns and line feeds inside a line count as
blanks; a member without any line that is not blank gives nothing; the same (member, line) twice
gives two results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
BLANK = r"^[\s\x{FEFF}]*$"


def field_pattern(delimiter: str) -> str:
    """A whole line of well-quoted fields; each alternative is told by its first character, so matching is linear."""
    d = re.escape(delimiter)
    one = f'(?:"(?:[^"]|"")*+"|(?!")[^{d}]*+)'
    return f"^{one}(?:{d}{one})*+$"


def is_date(cells: pa.Array) -> pa.Array:
    """Real dates of 8, 6 or 4 ASCII digits from 1900 to 2100."""
    shaped = pc.match_substring_regex(cells, r"^(19[0-9]{2}|20[0-9]{2}|2100)((0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])?)?$")
    whole = pc.and_(shaped, pc.equal(pc.utf8_length(cells), 8))
    safe = pc.if_else(whole, cells, "20000101")
    month, day, year = (pc.cast(pc.utf8_slice_codeunits(safe, a, b), pa.int32()) for a, b in ((4, 6), (6, 8), (0, 4)))
    leap = pc.and_(pc.equal(pc.subtract(year, pc.multiply(pc.divide(year, 4), 4)), 0), pc.invert(pc.is_in(year, pa.array([1900, 2100], pa.int32()))))
    longest = pc.if_else(pc.is_in(month, pa.array([4, 6, 9, 11], pa.int32())), 30, pc.if_else(pc.equal(month, 2), pc.if_else(leap, 29, 28), 31))
    return pc.and_(shaped, pc.less_equal(day, longest))


def rule_of(column: str) -> Callable[[pa.Array], pa.Array] | None:
    """The check for a column's trimmed cells, by the column's name; None if anything goes."""
    if column in ("primaryid", "caseid", "id"):
        return lambda cells: pc.match_substring_regex(cells, r"^[0-9]+$")
    if column == "nct_id":
        return lambda cells: pc.match_substring_regex(cells, r"^NCT[0-9]{8}$")
    if column.endswith("_dt"):
        return lambda cells: pc.or_(pc.equal(cells, ""), is_date(cells))
    return None


def split_header(header: str, delimiter: str) -> list[str]:
    """Column names of a header line: lower case, without blanks, quotes and byte-order mark."""
    return [x.strip().strip('"').strip().lower() for x in header.split(delimiter)]


def judge(lines: list[str], columns: list[str], delimiter: str, well_quoted: re.Pattern, fields: bool) -> tuple[list[str | None], list[list | None]]:
    """Cause of each line (None: loadable) and, if asked for, the trimmed fields of loadable lines."""
    causes: list[str | None] = [None if well_quoted.match(x) else "quoting" for x in lines]
    ask = [i for i, c in enumerate(causes) if c is None]
    values: list[list | None] = [None] * len(lines)
    if not ask:
        return causes, values
    width = len(columns)
    short: list[int] = []

    def on_invalid(row: pv.InvalidRow) -> str:
        # "Empty lines" never get here: each line starts with its own number
        short.append(int(row.text.split(delimiter, 1)[0]))
        return "skip"

    buffer = "\n".join(f"{i}{delimiter}{lines[i]}" for i in ask).encode()
    table = pv.read_csv(
        pa.BufferReader(buffer),
        read_options=pv.ReadOptions(use_threads=False, block_size=max(1 << 20, len(buffer) + 1), column_names=[f"c{k}" for k in range(width + 1)]),
        parse_options=pv.ParseOptions(delimiter=delimiter, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=on_invalid),
        convert_options=pv.ConvertOptions(column_types={f"c{k}": pa.string() if k else pa.int64() for k in range(width + 1)}, strings_can_be_null=False, check_utf8=False),
    ).combine_chunks()
    for i in short:
        causes[i] = "columns"
    numbers = table.column(0).to_pylist()
    if len(numbers) + len(short) != len(ask):
        raise ValueError(f"{len(ask)} lines gave {len(numbers)} rows and {len(short)} rejects")
    trimmed = [pc.utf8_trim_whitespace(table.column(k + 1)) for k in range(width)]
    fine = None
    for name, cells in zip(columns, trimmed):
        if rule := rule_of(name):
            ok = rule(cells)
            fine = ok if fine is None else pc.and_(fine, ok)
    good = fine.to_pylist() if fine is not None else [True] * len(numbers)
    rows = zip(*[c.to_pylist() for c in trimmed]) if fields else iter(())
    for i, ok in zip(numbers, good):
        row = next(rows, None)
        if not ok:
            causes[i] = "value"
        elif fields:
            values[i] = [x or None for x in row]
    return causes, values


def headers(lines: DataFrame) -> DataFrame:
    """(load_id, table_name, header, header_no): the first line of each member that is not blank."""
    shown = lines.where(F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike(BLANK) & F.col("line_no").isNotNull())
    first = shown.groupBy("load_id", "table_name").agg(F.min(F.struct("line_no", "raw_line")).alias("h"))
    return first.select("load_id", "table_name", F.col("h.line_no").alias("header_no"), F.regexp_replace("h.raw_line", r"^\x{FEFF}|\r$", "").alias("header"))


def judge_members(lines: DataFrame, delimiter: Column, fields: bool = False) -> DataFrame:
    """(load_id, table_name, line_no, cause[, raw_line, values]) for every data line of every member.

    ``values`` maps column names to the trimmed, empty-as-null fields of loadable lines. The header reaches the
    lines by a join salted on the line number, so that a member with a third of all lines is spread out.
    """
    heads = headers(lines).withColumn("delimiter", delimiter).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    heads = heads.select(F.col("load_id").alias("_l"), F.col("table_name").alias("_t"), "header_no", "header", "delimiter", F.col("salt").alias("_s"))
    data = lines.select("load_id", "table_name", "line_no", "raw_line").where(F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike(BLANK))
    data = data.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(SALTS)).cast("int"))
    on = (F.col("load_id").eqNullSafe(F.col("_l"))) & (F.col("table_name").eqNullSafe(F.col("_t"))) & (F.col("salt") == F.col("_s"))
    paired = data.join(heads, on).where(F.col("line_no") > F.col("header_no"))
    paired = paired.select("load_id", "table_name", "line_no", "raw_line", "header", "delimiter")
    schema = "load_id bigint, table_name string, line_no bigint, cause string" + (", raw_line string, values map<string,string>" if fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[tuple[str, str], list[str]] = {}
        patterns: dict[str, re.Pattern] = {}
        for batch in batches:
            raw, head, delim = (batch.column(c).to_pylist() for c in ("raw_line", "header", "delimiter"))
            groups: dict[tuple, list[int]] = {}
            for i, pair in enumerate(zip(head, delim)):
                names = layouts.get(pair)
                if names is None:
                    if len(layouts) > 4096:
                        layouts.clear()
                    names = layouts[pair] = split_header(*pair)
                groups.setdefault((pair[1], *names), []).append(i)
            causes: list[str | None] = [None] * len(raw)
            maps: list[list | None] = [None] * len(raw)
            for (d, *names), at in groups.items():
                clean = [raw[i].removesuffix("\r").removeprefix("﻿").replace("\r", " ").replace("\n", " ") for i in at]
                pattern = patterns.setdefault(d, re.compile(field_pattern(d)))
                got, rows = judge(clean, names, d, pattern, fields)
                for i, cause, row in zip(at, got, rows):
                    causes[i] = cause
                    if row is not None:
                        maps[i] = list(dict(zip(names, row)).items())
            out = [batch.column("load_id"), batch.column("table_name"), batch.column("line_no"), pa.array(causes, pa.string())]
            if fields:
                out += [batch.column("raw_line"), pa.array(maps, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=["load_id", "table_name", "line_no", "cause", *(["raw_line", "values"] if fields else [])])

    return paired.mapInArrow(run, schema)
