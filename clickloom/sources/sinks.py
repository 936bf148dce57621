"""Writers: reports, predictions, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.catalogue import Catalogue
from clickloom.operators.evaluate import last_prediction
from clickloom.operators.prepare import out_of_vocabulary
from clickloom.operators.splits import FILE, ROW, first_rows, shuffled

PREVIEW_ROWS = 3
PREVIEW_ITEMS = 5


def write_report(report: DataFrame, path: str) -> None:
    """The metric table as JSON lines. A report has catalogue size, so one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_oov_report(df: DataFrame, catalogue: Catalogue, path: str) -> None:
    out_of_vocabulary(df, catalogue).coalesce(1).write.mode("overwrite").json(path)


def write_predictions(scored: DataFrame, path: str, user: str, order: list[str], score: str = "prob") -> None:
    """One ``{user, score}`` JSON line per user, the last row of each user winning."""
    last_prediction(scored, user, order, score).write.mode("overwrite").json(path)


def export_first_rows(ordered: DataFrame, n: int, path: str) -> None:
    """The first ``n`` rows in file order as Parquet; ``ordered`` comes from ``read_table(file_order=True)``."""
    first_rows(ordered, n).drop(FILE, ROW).write.mode("overwrite").parquet(path)


def export_shuffled(df: DataFrame, ids: list[str], path: str, seed: int = 42, partitions: int | None = None) -> None:
    shuffled(df, ids, seed, partitions).drop("shuffle_key").write.mode("overwrite").parquet(path)


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS, items: int = PREVIEW_ITEMS) -> DataFrame:
    """The first rows with arrays cut to a few items; each array also gives its full length.

    Arrays are shown on the first row only, later rows hold NULL there.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    top = df.orderBy(*order).limit(rows)
    # at most `rows` rows reach this numbering
    numbered = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("row"))
    cols = []
    for c in df.columns:
        if c in names:
            first = F.col("row") == 1
            cols += [
                F.when(first, F.slice(c, 1, items)).alias(c),
                F.when(first, F.size(c)).alias(f"{c}_len"),
            ]
        else:
            cols.append(F.col(c))
    return numbered.select("row", *cols)
