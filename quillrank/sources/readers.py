"""Readers of interaction logs and features, by declarative specification."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReaderSpec:
    """A delimited log: columns by position (`_` is skipped), separator (any length), header, what to do with repeats
    ('raise', 'last' or 'sum') and the least rating that counts (None: all but 0)."""

    path: str
    columns: tuple[str, ...] = ("user_id", "item_id", "rating", "ts")
    sep: str = ","
    header: bool = False
    repeats: str = "raise"
    implicit_from: float | None = None
    types: dict[str, str] = field(default_factory=lambda: {"rating": "double", "ts": "double"})


#: Shapes of well-known public logs; the path is filled in by the caller.
KNOWN = {
    "movielens_100k": dict(sep="\t"),
    "movielens_1m": dict(sep="::"),
    "movielens_10m": dict(sep="::"),
    "movielens_20m": dict(sep=",", header=True),
    "movielens_hetrec": dict(sep="\t", header=True, columns=("user_id", "item_id", "rating", "_", "_", "_", "_", "_", "_")),
    "epinions": dict(sep=" ", columns=("user_id", "item_id", "rating")),
    "filmtrust": dict(sep=" ", columns=("user_id", "item_id", "rating")),
    "gowalla": dict(sep="\t", columns=("user_id", "_", "_", "_", "item_id"), repeats="sum"),
    "amazon_ratings": dict(sep=",", repeats="last"),
    "citeulike": dict(sep=" ", columns=("user_id", "item_id")),
    "pinterest": dict(sep="\t", columns=("user_id", "item_id")),
    "yelp": dict(sep="\t", repeats="last"),
    "tafeng": dict(sep=";", columns=("ts", "user_id", "_", "_", "_", "item_id", "rating"), repeats="sum"),
}


def spec(name: str, path: str, **changes) -> ReaderSpec:
    return ReaderSpec(path, **(KNOWN[name] | changes))


def read_interactions(spark: SparkSession, s: ReaderSpec) -> DataFrame:
    """user_id, item_id (strings), rating, ts (null if absent). Compressed files are read by their suffix. Lines with
    fewer fields than columns are dropped, as are zero ratings."""
    lines = spark.read.text(s.path)
    if s.header:
        head = lines.limit(1).first()
        lines = lines.filter(F.col("value") != F.lit(head["value"] if head else ""))
    parts = F.split("value", f"\\Q{s.sep}\\E", -1)
    lines = lines.select(parts.alias("p")).filter(F.size("p") >= len(s.columns))
    pick: dict[str, Column] = {c: F.trim(F.col("p")[i]) for i, c in enumerate(s.columns) if c != "_"}
    out = lines.select(*[x.cast(s.types.get(c, "string")).alias(c) for c, x in pick.items()])
    if "rating" not in pick:
        out = out.withColumn("rating", F.lit(1.0))
    if "ts" not in pick:
        out = out.withColumn("ts", F.lit(None).cast("double"))
    out = out.select("user_id", "item_id", "rating", "ts")
    if s.implicit_from is not None:
        out = out.filter(F.col("rating") >= s.implicit_from).withColumn("rating", F.lit(1.0))
    out = out.filter("rating <> 0")
    if s.repeats == "sum":
        return out.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating"), F.max("ts").alias("ts"))
    if s.repeats == "last":
        return keep_last(out)
    if not out.groupBy("user_id", "item_id").count().filter("count > 1").isEmpty():
        raise ValueError(f"{s.path}: repeated pairs of user and item")
    return out


def keep_last(df: DataFrame) -> DataFrame:
    """One row of each pair: the latest, and of equal times (or without any) the largest rating."""
    return df.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "rating")).alias("m")).select("user_id", "item_id", "m.rating", "m.ts")


def read_known_items(ratings: DataFrame, known: DataFrame) -> DataFrame:
    """Ratings of known items only; zeros go, new users stay."""
    return ratings.filter("rating <> 0").join(known.select("item_id").distinct(), "item_id", "left_semi").select("user_id", "item_id", "rating", "ts")


def token_features(df: DataFrame, id_col: str, text_col: str, sep: str = r"\|", distinct: bool = True) -> DataFrame:
    """id, feature, value: tokens of a delimited column; repeated ones count once, or as often as they come."""
    t = F.filter(F.split(text_col, sep), lambda x: x != "")
    rows = df.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(t) if distinct else t).alias("feature"))
    return rows.groupBy("item_id", "feature").agg(F.count("*").cast("double").alias("value"))


def demographic_features(df: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """One-hot features prefix_value of each column; nulls give none."""
    hot = F.array(*[F.concat(F.lit(f"{p}_"), F.col(c).cast("string")) for c, p in columns.items()])
    return df.select(F.col(id_col).alias("user_id"), F.explode(F.filter(hot, lambda x: x.isNotNull())).alias("feature")).withColumn("value", F.lit(1.0))


def read_json_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata, a JSON object a line: item_id, text (title, brand, categories and description)."""
    raw = spark.read.schema("asin string, title string, brand string, description string, categories array<array<string>>").json(path)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "brand")] + [F.coalesce(F.array_join(F.flatten("categories"), " "), F.lit("")), F.coalesce("description", F.lit(""))]
    return raw.filter("asin is not null").select(F.col("asin").alias("item_id"), F.concat_ws(" ", *parts).alias("text"))


def read_json_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, a JSON object a line: user_id, item_id, rating, ts, text (summary and review)."""
    raw = spark.read.schema("reviewerID string, asin string, overall double, unixReviewTime double, reviewText string, summary string").json(path)
    text = F.concat_ws(" ", F.coalesce("reviewText", F.lit("")), F.coalesce("summary", F.lit("")))
    return raw.select(F.col("reviewerID").alias("user_id"), F.col("asin").alias("item_id"), F.col("overall").alias("rating"), F.col("unixReviewTime").alias("ts"), text.alias("text"))


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines `label index:value index:value ...` whose first two indexes are the user's and the item's; label -1 is
    skipped."""
    p = F.split(F.trim("value"), r"\s+")
    index = lambda k: F.split(F.col("p")[k], ":")[0]
    rows = spark.read.text(path).select(p.alias("p")).filter((F.size("p") >= 3) & (F.col("p")[0].cast("double") > 0))
    return rows.select(index(1).alias("user_id"), index(2).alias("item_id")).distinct().withColumn("rating", F.lit(1.0))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of `item:` and then `user,rating,date` lines, a file or many: user_id, item_id, rating, ts. Each split of a
    file carries headers along its own lines; a split that starts amid a block gets the last header before it, found among
    one row for each split in the order of their offsets."""
    raw = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    head = F.when(F.col("value").endswith(":"), F.regexp_replace("value", ":$", ""))
    ends = rows.groupBy("file", "start").agg(F.max_by(head, F.when(head.isNotNull(), F.col("at"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    own = W.partitionBy("file", "start").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("own", F.last(head, ignorenulls=True).over(own)).filter(~F.col("value").endswith(":") & (F.trim("value") != ""))
    rows = rows.join(ends.select("file", "start", before.alias("before")), ["file", "start"]).withColumn("item_id", F.coalesce("own", "before"))
    p = F.split("value", ",")
    return rows.select(p[0].alias("user_id"), "item_id", p[1].cast("double").alias("rating"), F.unix_timestamp(p[2], "yyyy-MM-dd").cast("double").alias("ts"))
