"""Edit distance with transpositions, and suggestions from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings.

    No stretch is edited twice (optimal string alignment). Counted in code
    points; null if either is null. One fold over the letters of ``a`` carries
    the last two rows of the table, so it stays in the JVM; meant for names.
    """
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def table(s: Column) -> Column:
        x, y = s["x"], s["y"]
        width = F.size(y)
        zero = F.transform(F.sequence(F.lit(0), width), lambda j: j)
        begin = F.struct(zero.alias("old"), zero.alias("row"), F.lit("").alias("last"), F.lit(0).alias("i"))

        def next_row(state: Column, letter: Column) -> Column:
            old, row, last, i = state["old"], state["row"], state["last"], state["i"]

            def cell(done: Column, j: Column) -> Column:
                here = F.get(y, j - 1)
                change = F.get(row, j - 1) + F.when(here == letter, 0).otherwise(1)
                swap = F.when((i > 0) & (j > 1) & (letter == F.get(y, j - 2)) & (last == here), F.get(old, j - 2) + 1)
                return F.concat(done, F.array(F.least(F.get(done, j - 1) + 1, F.get(row, j) + 1, change, swap)))

            columns = F.when(width > 0, F.sequence(F.lit(1), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.struct(row.alias("old"), F.aggregate(columns, F.array(i + 1), cell).alias("row"), letter.alias("last"), (i + 1).alias("i"))

        return F.aggregate(x, begin, next_row, lambda state: F.get(state["row"], width))

    both = F.struct(letters(a).alias("x"), letters(b).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.get(F.transform(F.array(both), table), F.lit(0)))


def allowed_distance(a: Column, b: Column) -> Column:
    """Two fifths of the longer string, between 1 and 4."""
    return F.least(F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) * 2 / 5), F.lit(1)), F.lit(4))


def closest(names: DataFrame, asked: DataFrame) -> DataFrame:
    """The name that each asked string (asked) may mean: asked, name, distance.

    ``names`` (name) is a registry of repositories, or another short list; a
    name's part after its last slash counts too. Case is ignored, ties go to
    the first name in order, and strings with nothing near have no row.
    """
    last = F.regexp_extract("name", r"[^/]*$", 0)
    known = names.select(F.explode(F.array("name", last)).alias("name")).filter("name is not null").distinct()
    # Names of a length that four edits can reach meet, by equality of lengths.
    lengths = F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda d: F.length("asked") + d)).alias("length")
    near = asked.select("asked").distinct().select("asked", lengths).join(known.withColumn("length", F.length("name")), "length").drop("length")
    near = near.filter(edit_distance(F.lower("asked"), F.lower("name")) <= allowed_distance(F.col("asked"), F.col("name")))
    near = near.withColumn("distance", edit_distance(F.lower("asked"), F.lower("name")))
    order = Window.partitionBy("asked").orderBy("distance", "name")
    return near.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def distance(a: str, b: str) -> int:
    """Edits of one character and exchanges of two neighbours, each place edited once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def suggest(asked: str, names: list[str]) -> str | None:
    """The name of a short list that a string may mean, by whole names and their last parts."""
    near = [(distance(asked.lower(), part.lower()), n) for n in names for part in {n, n.rsplit("/", 1)[-1]} if distance(asked.lower(), part.lower()) <= min(4, max(1, max(len(asked), len(part)) * 2 // 5))]
    return min(near)[1] if near else None
