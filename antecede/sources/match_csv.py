"""Winner/loser match files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from antecede.sources.csv_text import header_groups, read_group, row_position

# fixed values: the columns every match file must have, in file order
REQUIRED = [
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date", "match_num",
    "winner_id", "winner_seed", "winner_entry", "winner_name", "winner_hand", "winner_ht", "winner_ioc",
    "winner_age", "winner_rank", "winner_rank_points", "loser_id", "loser_seed", "loser_entry", "loser_name",
    "loser_hand", "loser_ht", "loser_ioc", "loser_age", "loser_rank", "loser_rank_points", "score", "best_of",
    "round", "minutes", "w_ace", "w_df", "w_svpt", "w_1stIn", "w_1stWon", "w_2ndWon", "w_SvGms", "w_bpSaved",
    "w_bpFaced", "l_ace", "l_df", "l_svpt", "l_1stIn", "l_1stWon", "l_2ndWon", "l_SvGms", "l_bpSaved",
    "l_bpFaced",
]


class HeaderError(ValueError):
    """A file lacks required columns."""


def require_columns(df: DataFrame, required: Sequence[str], where: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise HeaderError(f"{where}: missing columns {missing}")
    return df


def read_matches(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files in the given order. (file_idx, row_seq) is the reading order duplicates are decided by.

    Every file is read by its own header, so columns may stand in any order and extra ones may follow.
    """
    frames = []
    for i, path in enumerate(paths):
        for columns, files in header_groups(spark, path):
            df = require_columns(read_group(spark, columns, files), REQUIRED, ", ".join(files))
            frames.append(df.select(*REQUIRED, F.lit(i).alias("file_idx"), F.lit(path).alias("source_file"), row_position().alias("row_seq")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def match_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED])
