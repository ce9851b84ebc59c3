"""Feature engineering as an estimator: fit collects small statistics, transform is one projection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.quantiles import quantiles
from gridloom.roles import ColumnRoles, require

MOST_INTERACTED = 10


@dataclass
class FeatureModel:
    log: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    encodings: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)
    interacted: list[str] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)

    def names(self, df: DataFrame) -> list[str]:
        """The columns that ``transform`` gives for such a table; no job."""
        return self.transform(df).columns

    def save(self, spark: SparkSession, path: str) -> None:
        """Lists and edges as JSON, each encoding as Parquet."""
        plain = {"log": self.log, "dates": self.dates, "interacted": self.interacted, "edges": self.edges, "defaults": {c: d for c, (_, d) in self.encodings.items()}}
        spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists")
        for i, (means, _) in enumerate(self.encodings.values()):
            means.write.mode("overwrite").parquet(f"{path}/means-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        plain = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/lists").collect()))
        encodings = {c: (spark.read.parquet(f"{path}/means-{i}"), d) for i, (c, d) in enumerate(plain["defaults"].items())}
        return cls(plain["log"], plain["dates"], encodings, plain["interacted"], plain["edges"])

    def transform(self, df: DataFrame, *also: str) -> DataFrame:
        """Originals less the replaced ones, then logs, date parts, encodings, products and bins; ``also`` last."""
        have = set(df.columns) - set(also)
        dates = [c for c in self.dates if c in have]
        encodings = {c: m for c, m in self.encodings.items() if c in have}
        for i, (c, (means, _)) in enumerate(encodings.items()):
            found = means.select(F.col(c).alias(f"k_{i}_"), F.col("mean_").alias(f"m_{i}_"))
            df = df.join(found, F.col(c).eqNullSafe(F.col(f"k_{i}_")), "left")  # high cardinality: sizes decide at run time
        out = [F.col(c) for c in df.columns if c in have and c not in dates and c not in encodings]
        out += [F.log1p(c).alias(f"{c}_log") for c in self.log if c in have]
        for c in dates:
            weekday = F.weekday(c) + 1
            out += [
                F.year(c).alias(f"{c}_year"),
                F.month(c).alias(f"{c}_month"),
                weekday.alias(f"{c}_day_of_week"),
                F.when(weekday >= 6, 1).otherwise(0).cast("tinyint").alias(f"{c}_is_weekend"),
                F.quarter(c).alias(f"{c}_quarter"),
            ]
        out += [F.coalesce(F.col(f"m_{i}_"), F.lit(default)).alias(f"{c}_target_enc") for i, (c, (_, default)) in enumerate(encodings.items())]
        out += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(self.interacted, 2) if {a, b} <= have]
        for c, edges in self.edges.items():
            if c in have:
                out.append(bin_label(F.col(c), edges[1:-1]).alias(f"{c}_bin"))
        return df.select(*out, *also)


def bin_label(x, inner: list[float]):
    """Right-closed interval of x between the inner edges, open at both ends; null stays null."""
    if not inner:
        return F.when(x.isNotNull(), "(-inf, inf]")
    names = ["-inf", *(f"{e:g}" for e in inner), "inf"]
    label = F.when(x <= inner[0], f"({names[0]}, {names[1]}]")
    for i in range(1, len(inner)):
        label = label.when(x <= inner[i], f"({names[i]}, {names[i + 1]}]")
    return label.when(x > inner[-1], f"({names[-2]}, {names[-1]}]")


@dataclass
class FeatureEngineer:
    """Which features to make; ``fit`` starts afresh each time."""

    interactions: bool = True
    log_transform: bool = True
    skew_threshold: float = 1.0
    date_features: bool = True
    target_encode: bool = True
    target_encode_threshold: int = 10
    auto_bin: bool = False
    n_bins: int = 5
    accuracy: int | None = None  #: approximate bin edges, for columns too large for exact ones

    def fit(self, df: DataFrame, target: str | None = None) -> FeatureModel:
        roles = ColumnRoles.of(df)
        numeric = [c for c in roles.numeric if c != target]
        text = [c for c in roles.text if c != target]
        model = FeatureModel(
            dates=[c for c in roles.temporal if c != target] if self.date_features else [],
            interacted=numeric[:MOST_INTERACTED] if self.interactions else [],
        )
        encoding = self.target_encode and target is not None and text
        points = [i / self.n_bins for i in range(self.n_bins + 1)]
        aggs = [F.lit(0).alias("zero_")]
        for c in numeric:
            x = F.col(c).cast("double")
            if self.log_transform:
                aggs += [F.skewness(x).alias(f"skew_{c}"), F.min(x).alias(f"min_{c}")]
            if self.auto_bin:
                aggs.append(quantiles(x, points, self.accuracy).alias(f"edges_{c}"))
        if encoding:
            require(df, target)
            for c in text:
                aggs.append((F.approx_count_distinct(c, 0.02) + F.max(F.col(c).isNull().cast("int"))).alias(f"about_{c}"))
        found = df.agg(*aggs).first().asDict()
        if self.log_transform:
            model.log = [c for c in numeric if (s := found[f"skew_{c}"]) is not None and abs(s) > self.skew_threshold and found[f"min_{c}"] >= 0]
        if self.auto_bin:
            for c in numeric:
                edges = sorted(set(found[f"edges_{c}"] or []))
                if len(edges) > 2:
                    model.edges[c] = edges
        for c in text if encoding else ():
            means = df.groupBy(c).agg(F.avg(F.col(target).cast("double")).alias("mean_"))
            exact = found[f"about_{c}"] > 2 * self.target_encode_threshold
            if exact or means.limit(self.target_encode_threshold + 1).count() > self.target_encode_threshold:
                default = means.agg(F.avg("mean_")).first()[0]
                model.encodings[c] = (means, default)
        return model

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)
