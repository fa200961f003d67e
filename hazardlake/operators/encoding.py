"""Feature roles and one-hot encoding fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quoted, signed_time
from ..session import materialize
from .cleaning import text_columns
from .numbering import numbered

#: Categories up to which the vocabulary is broadcast.
BROADCAST_CATEGORIES = 200_000
EVENT, TIME = "event_occurred", "observed_time"
_NOT_FEATURES = (EVENT, TIME, "row_id", "case_id", "split", "fold", "fit")


@dataclass
class Roles:
    """Which columns are numeric and which are categorical features."""

    numeric: list[str]
    categorical: list[str]


def feature_roles(df: DataFrame, ignore: Sequence[str] = ()) -> Roles:
    skip = {*_NOT_FEATURES, *ignore}
    texts = text_columns(df, skip)
    return Roles([c for c in df.columns if c not in skip and c not in texts], texts)


def add_signed_label(df: DataFrame) -> DataFrame:
    """Label of the boosted model: time for events, minus time for censored rows."""
    return df.withColumn("signed_time", signed_time(F.col(EVENT), F.col(TIME)))


@dataclass
class Encoder:
    """Numeric columns first, then one 0/1 column per category but the first."""

    numeric: list[str]
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        dummies = [f"{c}_{v}" for c, values in self.categories.items() for v in values[1:]]
        return [*self.numeric, *dummies]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encode any table with the training categories.

        NULL and unseen categories are all zero, and the dropped first category is the
        training one even if the table at hand lacks it. A feature column the table does
        not have counts as 0.
        """
        have = set(df.columns)
        out = [
            (quoted(c) if c in have else F.lit(0.0)).cast("double").alias(c) for c in self.numeric
        ]
        for c, values in self.categories.items():
            source = quoted(c) if c in have else F.lit(None).cast("string")
            out += [
                F.coalesce(source == F.lit(v), F.lit(False)).cast("double").alias(f"{c}_{v}")
                for v in values[1:]
            ]
        return df.select(*[quoted(k) for k in keep], *out)

    def table(self, spark: SparkSession) -> DataFrame:
        """Encoder as a model table; also the ordered training-column list."""
        rows = [(0, i, c, None) for i, c in enumerate(self.numeric)]
        for i, (c, values) in enumerate(self.categories.items()):
            rows += [(1 + i, j, c, v) for j, v in enumerate(values)]
        return spark.createDataFrame(rows, "block int, position int, source string, category string")

    @staticmethod
    def from_table(table: DataFrame) -> Encoder:
        rows = table.orderBy("block", "position").collect()
        categories: dict[str, list[str]] = {}
        for r in rows:
            if r.block:
                categories.setdefault(r.source, []).append(r.category)
        return Encoder([r.source for r in rows if not r.block], categories)


def fit_encoder(train: DataFrame, roles: Roles, max_categories: int | None = None) -> Encoder:
    """Sorted distinct categories of the training rows, from one pass over them.

    Categories become columns, so the driver holds as many names as the result has columns.
    With ``max_categories`` the fit stops with an error beyond so many.
    """
    if not roles.categorical:
        return Encoder(list(roles.numeric))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), quoted(c).alias("v")) for i, c in enumerate(roles.categorical)
    ]))
    distinct = train.select(pairs.alias("p")).select("p.i", "p.v").filter(F.col("v").isNotNull()).distinct()
    found = (distinct if max_categories is None else distinct.limit(max_categories + 1)).collect()
    if max_categories is not None and len(found) > max_categories:
        raise ValueError(f"more than {max_categories} categories to one-hot encode")
    categories = {c: [] for c in roles.categorical}
    for r in sorted(found):
        categories[roles.categorical[r.i]].append(r.v)
    return Encoder(list(roles.numeric), categories)


@dataclass
class SparseEncoder:
    """One-hot features as positions: numeric columns stay columns, all 0/1 features are one array of the ones' places.

    The vocabulary is a table (source, category, place), so neither the driver nor a schema holds the categories; the driver knows
    how many there are. As in ``Encoder`` the first category of every column has no place.
    """

    numeric: list[str]
    categorical: list[str]
    vocabulary: DataFrame
    width: int

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep``, the numeric columns and ``flags``, the ascending places of a row's categories.

        NULL, unseen and first categories have no place; columns the table lacks count as 0 or NULL.
        """
        have = set(df.columns)
        out = df.select(
            *[quoted(k) for k in keep],
            *[(quoted(c) if c in have else F.lit(0.0)).cast("double").alias(c) for c in self.numeric],
            *[(quoted(c) if c in have else F.lit(None)).cast("string").alias(f"__v{i}") for i, c in enumerate(self.categorical)],
        )
        small = self.width <= BROADCAST_CATEGORIES
        for i in range(len(self.categorical)):
            mine = self.vocabulary.filter(F.col("source") == i).select(F.col("category").alias(f"__v{i}"), F.col("place").alias(f"__p{i}"))
            out = out.join(F.broadcast(mine) if small else mine, f"__v{i}", "left")
        places = [F.col(f"__p{i}") for i in range(len(self.categorical))]
        flags = F.array_sort(F.array_compact(F.array(*places))) if places else F.array()
        return out.select(*[quoted(c) for c in (*keep, *self.numeric)], flags.cast("array<int>").alias("flags"))

    def names(self) -> DataFrame:
        """(place, feature) of the 0/1 features."""
        source = F.element_at(F.lit(self.categorical), F.col("source") + 1) if self.categorical else F.lit("")
        return self.vocabulary.select("place", F.concat_ws("_", source, F.col("category")).alias("feature"))


def fit_sparse_encoder(train: DataFrame, roles: Roles) -> SparseEncoder:
    """The categories of the training rows in sorted order, numbered as a table."""
    pairs = [F.struct(F.lit(i).alias("source"), quoted(c).cast("string").alias("category")) for i, c in enumerate(roles.categorical)]
    spark = train.sparkSession
    if not pairs:
        return SparseEncoder(list(roles.numeric), [], spark.createDataFrame([], "source int, category string, place int"), 0)
    seen = train.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("category is not null").distinct()
    first = seen.groupBy("source").agg(F.min("category").alias("first"))
    later = seen.join(F.broadcast(first), "source").filter("category <> first").drop("first")
    placed = numbered(later, [F.col("source").asc(), F.col("category").asc()])
    table = materialize(placed.select("source", "category", F.col("place").cast("int").alias("place")), "vocabulary")
    return SparseEncoder(list(roles.numeric), list(roles.categorical), table, table.count())
