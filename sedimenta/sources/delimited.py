"""Unquoted delimited lines: split, typed rows and rejects, in plain columns.

The first line of a member that is not blank is its header (lower case, trimmed) unless a header is declared;
quotes are data; a line with another number of fields than the header is rejected with the verbatim line, its
number and its first field; blank lines are no rows; fields are trimmed, empty ones null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import scalars
from sedimenta.sources.tables import TableSpec

MOST_RAW = 2000


def split_lines(lines: DataFrame, spec: TableSpec, member: list[str]) -> DataFrame:
    """Adds ``header``, ``fields`` and ``reason`` to the data lines; ``member`` are the columns that tell members apart."""
    shown = lines.where(F.col("line").isNotNull() & (scalars.strip(F.col("line")) != ""))
    cells = F.split(F.col("line"), rf"\Q{spec.delimiter}\E", -1)
    if spec.header:
        data = shown.withColumn("header", F.array(*[F.lit(h) for h in spec.header]))
    else:
        first = shown.groupBy(*member).agg(F.min(F.struct("line_no", "line")).alias("_h"))
        names = F.transform(F.split(F.col("_h.line"), rf"\Q{spec.delimiter}\E", -1), lambda x: F.lower(scalars.strip(x)))
        heads = first.select(*[F.col(m).alias(f"_{m}") for m in member], F.col("_h.line_no").alias("_no"), names.alias("header"))
        # few members, each one row: AQE broadcasts this side if it is small, else both are shuffled
        on = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in member]
        data = shown.join(heads, on).where(F.col("line_no") > F.col("_no")).drop("_no", *[f"_{m}" for m in member])
    data = data.withColumn("fields", F.transform(cells, scalars.clean_field))
    wrong = F.size("fields") != F.size("header")
    reason = F.when(wrong, F.concat(F.lit("expected "), F.size("header"), F.lit(" fields, got "), F.size("fields")))
    return data.withColumn("reason", reason)


def parse(lines: DataFrame, spec: TableSpec, member: list[str], limit: int | None = None) -> DataFrame:
    """Typed columns of a spec beside line_no, line, key_hint and reason; loadable rows have a null reason.

    ``limit`` keeps the first data lines of each member, loaded and rejected alike.
    """
    split = split_lines(lines, spec, member)
    if limit is not None:
        from pyspark.sql import Window

        order = Window.partitionBy(*member).orderBy("line_no")
        split = split.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    n = F.size("header")
    cell = F.map_from_arrays(F.col("header"), F.slice(F.concat("fields", F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n))
    split = split.withColumn("_cells", F.when(F.col("reason").isNull(), cell))
    # a generator of one row keeps the cells from being written into every expression that reads them
    texts = F.struct(F.try_element_at("fields", F.lit(1)).alias("key_hint"), F.col("reason").alias("reason"), *[F.col("_cells")[name].alias(f"c{i}") for i, (name, _) in enumerate(spec.columns)])
    told = split.select(*member, "line_no", "line", F.explode(F.array(texts)).alias("_t")).select(*member, "line_no", "line", "_t.*")
    place = {name: f"c{i}" for i, (name, _) in enumerate(spec.columns)}
    field = lambda name: F.col(place[name])
    reason = F.coalesce(F.col("reason"), spec.identity_problem(field))
    return told.select(*member, "line_no", "line", "key_hint", reason.alias("reason"), *spec.build(field))


def loadable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull())


def rejected(parsed: DataFrame, member: list[str]) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(*member, "line_no", "reason", F.left("line", F.lit(MOST_RAW)).alias("raw_line"), "key_hint")
