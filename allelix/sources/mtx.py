"""Matrix Market files: coordinate and array layout; integer, real and pattern values; all symmetries of real matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.sources.files import check_file, first_lines, numbered_lines, write_lines
from allelix.tables import counted_up

LAYOUTS, KINDS, SYMMETRIES = ("coordinate", "array"), ("integer", "real", "pattern"), ("general", "symmetric", "skew-symmetric")


def banner(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """Layout, kind of values and symmetry; what can't be read is an error."""
    check_file(spark, path)
    first = (first_lines(spark, path, 1) or [""])[0]
    words = first.lower().split()
    if len(words) != 5 or words[:2] != ["%%matrixmarket", "matrix"]:
        raise ValueError(f"{path} does not begin with a Matrix Market banner: {first[:80]}")
    for word, known, what in zip(words[2:], (LAYOUTS, (*KINDS, "double"), SYMMETRIES), ("layout", "kind of values", "symmetry"), strict=True):
        if word not in known:
            raise ValueError(f"{path}: {what} {word} is not one of {', '.join(known)}")
    layout, kind, symmetry = words[2:]
    if kind == "pattern" and (layout == "array" or symmetry == "skew-symmetric"):
        raise ValueError(f"{path}: a pattern has no {layout if layout == 'array' else symmetry} matrix")
    return layout, "real" if kind == "double" else kind, symmetry


def _dense(body: DataFrame, n_rows: int, n_cols: int, symmetry: str, number, name: str) -> tuple[DataFrame, int]:
    """Entries of an array, whose values go column by column; of a symmetric matrix from the diagonal down, of a skew-symmetric one from below it."""
    at = counted_up(body, "_place").withColumn("_place", F.col("_place") - 1)  # comments and empty lines don't count
    value = number(F.col("value")).alias(name)
    if symmetry == "general":
        return at.select((F.col("_place") % n_rows + 1).alias("row"), F.floor(F.col("_place") / n_rows + 1).cast("long").alias("col"), value), n_rows * n_cols
    below = int(symmetry == "skew-symmetric")
    n = n_rows - below  # values of the first column; each further column has one less
    most = n * (n + 1) // 2
    # counted from the end, columns have 1, 2, 3 ... values
    left = F.lit(most - 1) - F.col("_place")
    k = F.floor((F.sqrt(8.0 * left + 1.0) - 1) / 2).cast("long")
    k = F.when(k * (k + 1) / 2 > left, k - 1).when((k + 1) * (k + 2) / 2 <= left, k + 1).otherwise(k)
    placed = at.withColumns({"_k": k, "_left": left})
    return placed.select((F.lit(n_rows) - (F.col("_left") - F.col("_k") * (F.col("_k") + 1) / 2).cast("long")).alias("row"), (F.lit(n) - F.col("_k")).alias("col"), value), most


def read_mtx(spark: SparkSession, path: str, name: str = "value", check: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """(row, col, value) with 1-based positions, repeats summed, zeros left out; and the stated shape."""
    entries, shape = read_entries(spark, path, name, check)
    return entries.groupBy("row", "col").agg(F.sum(name).alias(name)).filter(F.col(name) != 0), shape


def read_entries(spark: SparkSession, path: str, name: str = "value", check: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """(row, col, value) with 1-based positions, as they stand; and the stated shape. Only the head comes to the driver.

    Values are longs, or doubles of a real matrix; an entry of a pattern is 1. Of symmetric matrices the half that the
    file lacks is put in, of skew-symmetric ones with the other sign. check: the file has as many entries as it states.
    """
    layout, kind, symmetry = banner(spark, path)
    lines = numbered_lines(spark, path).select("_ord", F.trim("value").alias("value")).filter(~F.col("value").startswith("%") & (F.col("value") != ""))
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} states no shape")
    n_rows, n_cols, *stated = map(int, head["value"].split())
    body, parts = lines.filter(F.col("_ord") != head["_ord"]), F.split("value", r"\s+")
    number = (lambda c: c.cast("double")) if kind == "real" else (lambda c: c.cast("long"))
    if layout == "coordinate":
        value = F.lit(1).cast("long") if kind == "pattern" else number(F.get(parts, F.lit(2)))
        entries = body.select(F.get(parts, 0).cast("long").alias("row"), F.get(parts, 1).cast("long").alias("col"), value.alias(name))
        most = stated[0]
    else:
        entries, most = _dense(body, n_rows, n_cols, symmetry, number, name)
    if symmetry != "general":
        if n_rows != n_cols:
            raise ValueError(f"{path}: a {symmetry} matrix of {n_rows} rows and {n_cols} columns")
        sign = -1 if symmetry == "skew-symmetric" else 1
        entries = entries.unionAll(entries.filter("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col(name) * sign).alias(name)))
    if check and (found := body.count()) != most:
        raise ValueError(f"{path} states {most} entries and has {found}")
    return entries, (n_rows, n_cols)


def write_mtx(entries: DataFrame, shape: tuple[int, int], path: str, name: str = "value", symmetry: str = "general", pattern: bool = False) -> None:
    """Coordinate layout, column by column. Doubles are written as real values, all else as integers; pattern: places alone.

    Of a symmetric matrix, which is not checked to be one, the lower half is written.
    """
    kind = "pattern" if pattern else "real" if dict(entries.dtypes)[name] in ("double", "float") or dict(entries.dtypes)[name].startswith("decimal") else "integer"
    kept = entries.filter(F.col(name) != 0)
    if symmetry != "general":
        kept = kept.filter(F.col("row") >= F.col("col"))
    value = [] if pattern else [F.col("value").cast("double" if kind == "real" else "long").cast("string")]
    head = [f"%%MatrixMarket matrix coordinate {kind} {symmetry}", "%", f"{shape[0]} {shape[1]} {kept.count()}"]
    line = F.concat_ws(" ", F.col("_ord.row").cast("string"), F.col("_ord.col").cast("string"), *value)
    write_lines(kept.select(F.struct("col", "row").alias("_ord"), *([] if pattern else [F.col(name).alias("value")])), path, head, line=line)
