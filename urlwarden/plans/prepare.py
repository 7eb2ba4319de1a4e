"""Dataset preparation: features, split, outliers, scaling, resampling, parquet, manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.operators import resample, scaling
from urlwarden.operators.outliers import IsolationForest, fit_forest
from urlwarden.operators.split import split
from urlwarden.session import materialise
from urlwarden.sources.manifest import fingerprint, write_manifest

STRATEGIES = ("none", "smote", "smote_tomek", "adasyn")


@dataclass(frozen=True)
class PrepConfig:
    test: float = 0.20
    val: float = 0.10
    seed: int = 42
    reject_outliers: bool = True
    contamination: float = 0.02
    strategy: str = "smote_tomek"


@dataclass
class FittedTransforms:
    features: list[str]
    robust: dict[str, tuple[float, float]]
    power: dict[str, float]
    standard: dict[str, tuple[float, float]]
    forest: IsolationForest | None = None

    def scaled(self, df: DataFrame) -> DataFrame:
        return scaling.apply_scale(df, self.robust)

    def transform(self, df: DataFrame) -> DataFrame:
        """Robust scale, power transform, standardise: one projection."""
        return scaling.apply_scale(scaling.apply_power(self.scaled(df), self.power), self.standard)

    def save(self, spark, path: str) -> None:
        rows = [(c, *self.robust[c], self.power[c], *self.standard[c]) for c in self.features]
        spark.createDataFrame(rows, "feature string, median double, iqr double, lambda double, "
                                    "mean double, deviation double").coalesce(1).write.parquet(f"{path}/columns")
        if self.forest is not None:
            spark.createDataFrame(self.forest.nodes).withColumns({
                "sample": F.lit(self.forest.sample), "offset": F.lit(self.forest.offset)
            }).coalesce(1).write.parquet(f"{path}/forest")


def load_transforms(spark, path: str, with_forest: bool = True) -> FittedTransforms:
    rows = spark.read.parquet(f"{path}/columns").collect()  # one row per feature
    forest = None
    if with_forest:
        nodes = spark.read.parquet(f"{path}/forest").toPandas()  # bounded by the forest size
        forest = IsolationForest(nodes.drop(columns=["sample", "offset"]),
                                 int(nodes["sample"].iloc[0]), float(nodes["offset"].iloc[0]))
    return FittedTransforms(
        [r["feature"] for r in rows], {r["feature"]: (r["median"], r["iqr"]) for r in rows},
        {r["feature"]: r["lambda"] for r in rows},
        {r["feature"]: (r["mean"], r["deviation"]) for r in rows}, forest)


def _vector(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def fit_transforms(train: DataFrame, id_col: str, features: list[str],
                   cfg: PrepConfig = PrepConfig()) -> FittedTransforms:
    robust = scaling.fit_robust(train, features)
    # Few bytes and much work a row: the grids of the power fit would else run in the task that reads the file.
    dealt = scaling.apply_scale(train, robust).repartition(train.sparkSession.sparkContext.defaultParallelism)
    scaled = materialise(dealt, "prep-scaled")
    power = scaling.fit_power(scaled, features, refine=2)
    standard = scaling.fit_standard(scaling.apply_power(scaled, power), features)
    forest = None
    if cfg.reject_outliers:
        forest = fit_forest(scaled.select(F.col(id_col).alias("id"), _vector(features).alias("vec")),
                            cfg.contamination, seed=cfg.seed)
    return FittedTransforms(features, robust, power, standard, forest)


def balance(train: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """Resample (id, vec, label) rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "none":
        return train.select("id", "vec", F.col("label").cast("int").alias("label"))
    return getattr(resample, strategy)(train, seed)


def prepare(df: DataFrame, id_col: str, target: str, features: list[str],
            cfg: PrepConfig = PrepConfig()) -> tuple[dict[str, DataFrame], FittedTransforms]:
    """The three splits as (features…, target); fitted on train, only train loses outliers and is resampled."""
    data = materialise(split(df.select(id_col, target, *features), id_col, target, cfg.test, cfg.val,
                             cfg.seed), "prep-split")
    train = data.where(F.col("split") == "train")
    fitted = fit_transforms(train, id_col, features, cfg)
    if cfg.reject_outliers:
        outliers = fitted.forest.scored.where(F.col("score") < F.lit(fitted.forest.offset))
        train = train.join(outliers.select(F.col("id").alias(id_col)), id_col, "left_anti")
    rows = fitted.transform(train).select(F.col(id_col).alias("id"), _vector(features).alias("vec"),
                                          F.col(target).alias("label"))
    grown = balance(rows, cfg.strategy, cfg.seed)
    out = {"train": grown.select(*[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
                                 F.col("label").alias(target))}
    for name in ("val", "test"):
        part = fitted.transform(data.where(F.col("split") == name))
        out[name] = part.select(*features, F.col(target).cast("int").alias(target))
    return out, fitted


def write_prepared(splits: dict[str, DataFrame], fitted: FittedTransforms, path: str,
                   cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Write the splits as zstd parquet, the transforms and the run metadata; returns the metadata."""
    spark = splits["train"].sparkSession
    sizes = {}
    for name, df in splits.items():
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        sizes[name] = spark.read.parquet(f"{path}/{name}").count()
    fitted.save(spark, f"{path}/transforms")
    mark = fingerprint(spark.read.parquet(f"{path}/train")).first()
    return write_manifest(
        spark, f"{path}/metadata", dataset_fingerprint=mark["fingerprint"],
        feature_names=fitted.features, num_features=len(fitted.features),
        train_samples=sizes["train"], val_samples=sizes["val"], test_samples=sizes["test"],
        resampling_applied=cfg.strategy)
