"""Feature engineering.

SQL-shaped features are plain DataFrame expressions; the Spark ML stages
(OneHotEncoder, StringIndexer, QuantileDiscretizer, MinMaxScaler, Pipeline)
are offered next to them for users who want fitted models.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, QuantileDiscretizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.columns import INCLUSIVE_LIKE_THRESHOLD, clean_title, like_label, release_year, split_genres
from reelspark.operators.indexing import global_row_number, ntile_from_position
from reelspark.operators.windows import CHUNK_ROWS, sliding_frame

HISTORY_ROWS = 100   # fixed value: the reference's frame is the 100 preceding ratings


def item_rating_features(ratings: DataFrame) -> DataFrame:
    """A5: count, mean and sample variance of scores per item."""
    return ratings.groupBy("mid").agg(
        F.count(F.lit(1)).alias("rating_count"),
        F.avg("score").alias("avg_rating"),
        F.var_samp("score").alias("rating_var"))


def min_max_scaled(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min), 0.5 when all values are equal (as MinMaxScaler).

    min and max are fitted first, two numbers from one aggregation; the table is
    then read once more. No window over the whole table.
    """
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0.5)))
    return df.withColumn(out, (F.col(col) - F.lit(ends["lo"])) / F.lit(ends["hi"] - ends["lo"]))


def exact_quantile_buckets(df: DataFrame, order: list[str], buckets: int, out: str) -> DataFrame:
    """F5, exact form: ``ntile(buckets) over (order by ...)`` computed from a
    distributed global position (no single-partition window)."""
    total = df.count()
    pos = global_row_number(df, order, "_pos")
    return pos.withColumn(out, ntile_from_position(F.col("_pos"), total, buckets)).drop("_pos")


def ml_item_stages(item_features: DataFrame, buckets: int = 100) -> DataFrame:
    """two fitted ML stages (QuantileDiscretizer on the count, MinMaxScaler
    on the mean). Fitting collects only quantile sketches and min/max."""
    stages = [
        QuantileDiscretizer(numBuckets=buckets, inputCol="rating_count", outputCol="count_bucket",
                            relativeError=0.0001),
        VectorAssembler(inputCols=["avg_rating"], outputCol="avg_vec"),
        MinMaxScaler(inputCol="avg_vec", outputCol="avg_scaled_vec"),
    ]
    model = Pipeline(stages=stages).fit(item_features)
    from pyspark.ml.functions import vector_to_array
    return (model.transform(item_features)
            .withColumn("avg_scaled", vector_to_array("avg_scaled_vec")[0])
            .drop("avg_vec", "avg_scaled_vec"))


def one_hot_ids(df: DataFrame, id_col: str) -> DataFrame:
    """one-hot of an integer id, dropLast=false: (id, vec_size, hot_index)."""
    size = df.agg((F.max(id_col) + 1).cast("bigint")).scalar()
    return df.select(id_col, size.alias("vec_size"), F.col(id_col).cast("bigint").alias("hot_index"))


def genre_frequency_index(items: DataFrame) -> DataFrame:
    """StringIndexer(frequencyDesc) over the genre tokens of all items:
    most frequent genre gets 0, ties by name."""
    counts = (items.select(F.explode(split_genres(F.col("genres"))).alias("genre"))
              .groupBy("genre").agg(F.count(F.lit(1)).alias("freq")))
    return global_row_number(counts, [F.col("freq").desc(), F.col("genre").asc()], "genre_idx")


def multi_hot_genres(items: DataFrame, genre_index: DataFrame) -> DataFrame:
    """The set of genre indexes per item, one row per (item, index);
    a repeated genre gives one index."""
    exploded = items.select("mid", F.explode(split_genres(F.col("genres"))).alias("genre")).distinct()
    return exploded.join(genre_index.select("genre", "genre_idx"), "genre").select("mid", "genre_idx")


def sample_item_features(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """F8 item half: label, item columns, first three genres and the per-item
    rating statistics joined back (J11, J12, A6, P17).

    The per-item statistics are a grouped aggregate joined back on ``mid``,
    not a window per item: the aggregate combines map-side, and a hot item's
    join partition is split by AQE's skew join.
    """
    s = (ratings.withColumn("label", like_label(F.col("score"), INCLUSIVE_LIKE_THRESHOLD, strict=False))
         .join(items, "mid", "left"))
    g = split_genres(F.col("genres"))
    s = s.select("uid", "mid", "score", "ts", "label", "genres",
                 release_year(F.col("title")).alias("release_year"),
                 clean_title(F.col("title")).alias("title"),
                 F.get(g, 0).alias("movie_genre1"), F.get(g, 1).alias("movie_genre2"),
                 F.get(g, 2).alias("movie_genre3"))
    per_item = s.groupBy("mid").agg(
        F.count(F.lit(1)).alias("movie_rating_count"),
        F.avg("score").alias("movie_avg_rating"),
        F.stddev_samp("score").alias("movie_rating_stddev"))
    return s.join(per_item, "mid", "left")


def _last_rows(w: Window, value: Column) -> Column:
    """Sum over the last HISTORY_ROWS rows as the difference of two running sums:
    one addition per row, and exact for years (integers) and scores (halves)."""
    until = lambda end: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0))
    return until(-1) - until(-1 - HISTORY_ROWS)


def _user_history_cols(w: Window) -> list:
    year, score = F.col("release_year").cast("double"), F.col("score")
    present = lambda c: F.when(c.isNotNull(), F.lit(1.0))
    sums = {"_ny": present(year), "_y": year, "_yy": year * year, "_ns": present(score), "_s": score, "_ss": score * score}
    liked = F.when(F.col("label") == 1, F.struct("mid", "genres"))
    return [*[_last_rows(w, c).alias(n) for n, c in sums.items()],
            F.reverse(F.collect_list(liked).over(w.rowsBetween(-HISTORY_ROWS, -1))).alias("_liked")]


def _mean(n: Column, total: Column) -> Column:
    return F.when(n > 0, total / n)


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from sums; null for fewer than two values."""
    return F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))


def _most_frequent(lists: pa.Array, k: int, cells: int = 1 << 22) -> pa.Array:
    """Of each list of ``A|B|C`` strings the k most frequent genres, ties by name.
    Each distinct string is split once; genres are counted as numbers, ``cells`` counts at a time."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    split, codes = [g.split("|") for g in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False)
    names = sorted({t for g in split for t in g})
    if not names:
        return pa.array([[]] * len(n), pa.list_(pa.string()))
    number, t = {g: i for i, g in enumerate(names)}, len(names)
    sizes = np.array([len(g) for g in split], np.int64)
    genre, start = np.array([number[x] for g in split for x in g], np.int64), np.cumsum(sizes) - sizes
    first, step, kept, found = np.append(0, np.cumsum(n)), max(1, cells // t), [], []
    for lo in range(0, len(n), step):
        hi = min(lo + step, len(n))
        code = codes[first[lo]:first[hi]]
        m = sizes[code]
        row = np.repeat(np.repeat(np.arange(hi - lo), n[lo:hi]), m)
        at = np.arange(m.sum()) + np.repeat(start[code] - (np.cumsum(m) - m), m)
        count = np.bincount(row * t + genre[at], minlength=(hi - lo) * t).reshape(hi - lo, t)
        order = np.where(count > 0, np.arange(t) - count * (t + 1), 1)  # the least is the most frequent, then the first by name
        best = np.argpartition(order, k - 1, axis=1)[:, :k] if t > k else np.broadcast_to(np.arange(t), count.shape)
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(order, best, axis=1), axis=1), axis=1)
        there = np.take_along_axis(count, best, axis=1) > 0
        kept.append(there.sum(axis=1))
        found.append(best[there])
    ends = np.append(0, np.cumsum(np.concatenate(kept or [np.empty(0, np.int64)]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(names).take(pa.array(np.concatenate(found or [np.empty(0, np.int64)]))))


def sample_user_features(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """F8 user half (W1-W7): statistics of the user's up-to-100 preceding ratings,
    current row excluded (no label leakage). Order is (ts, mid). Counts, means
    and deviations come from running sums; only the frame's liked rows are
    collected, for the last five items and the genre ranking, which is counted
    by batches of rows after the window."""
    framed = sliding_frame(samples, "uid", ["ts", "mid"], HISTORY_ROWS, _user_history_cols, chunk_rows)
    genres = F.filter(F.col("_liked.genres"), lambda g: g.isNotNull())
    @F.arrow_udf("array<string>")
    def most_frequent(lists: pa.Array) -> pa.Array:
        return _most_frequent(lists, 5)
    ranked = framed.withColumn("_genres", most_frequent(genres))
    return ranked.select(
        *samples.columns, F.least(F.col("_p"), F.lit(HISTORY_ROWS)).cast("bigint").alias("user_rating_count"),
        _mean(F.col("_ny"), F.col("_y")).alias("user_avg_release_year"),
        _deviation(F.col("_ny"), F.col("_y"), F.col("_yy")).alias("user_release_year_stddev"),
        _mean(F.col("_ns"), F.col("_s")).alias("user_avg_rating"),
        _deviation(F.col("_ns"), F.col("_s"), F.col("_ss")).alias("user_rating_stddev"),
        *[F.get(F.col("_liked.mid"), i).alias(f"user_rated_movie{i + 1}") for i in range(5)],
        *[F.get(F.col("_genres"), i).alias(f"user_genre{i + 1}") for i in range(5)])
