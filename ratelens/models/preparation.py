"""Column roles and the preprocessing stages of a rate model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.errors import ContractError
from ratelens.functions.dictionary import sorted_ranks, widths, with_ranks
from ratelens.models.imputers import MedianImputer, ModeImputer
from ratelens.operators.quality import guard_features
from ratelens.sources.schemas import KEY, TARGET, numeric_columns, text_columns


@dataclass(frozen=True)
class Roles:
    """Model inputs found by type, in table order. Dates and other types are not inputs."""

    numeric: list[str]
    categorical: list[str]


def model_inputs(df: DataFrame, target: str = TARGET, key: str = KEY) -> DataFrame:
    """Drop target and key; absent ones are ignored, as at scoring time."""
    return df.drop(target, key)


def column_roles(schema: T.StructType, target: str = TARGET, key: str = KEY) -> Roles:
    """Text -> categorical, numbers and booleans -> numeric; target and key are left out."""
    allowed = set(guard_features(schema.names, target)) - {key}
    return Roles(
        [c for c in numeric_columns(schema) if c in allowed],
        [c for c in text_columns(schema) if c in allowed],
    )


def imputation_stages(roles: Roles) -> list:
    """Median and most-frequent imputers."""
    stages = []
    if roles.numeric:
        stages.append(MedianImputer(inputCols=roles.numeric))
    if roles.categorical:
        stages.append(ModeImputer(inputCols=roles.categorical))
    return stages


def encoding_stages(roles: Roles, output: str = "features") -> list:
    """Sorted one-hot categories (unseen values give all zeros) assembled into a sparse vector.

    The indexer keeps one extra, last index for unseen values and the encoder drops it
    again, so the vector width is the number of categories seen at fit time.
    """
    index = [f"{c}__index" for c in roles.categorical]
    onehot = [f"{c}__onehot" for c in roles.categorical]
    return [
        StringIndexer(
            inputCols=roles.categorical, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True),
        VectorAssembler(inputCols=[*roles.numeric, *onehot], outputCol=output),
    ]


class _SparseParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric inputs", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text inputs", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "sparse row", TypeConverters.toString)


class SparseAssembler(Estimator, _SparseParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers and sorted one-hot categories as one sparse row: ``size, indices, values``.

    The dictionary of the categories is a table: it is made, kept and joined on the cluster, so a column may have any number
    of categories. A value unseen at fit time, or missing, sets no indicator.
    """

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SparseAssemblerModel:
        texts = self.getOrDefault(self.categoricalCols)
        ranks = sorted_ranks(dataset, texts)
        sizes = widths(ranks, texts)
        model = SparseAssemblerModel(ranks)
        model._set(
            numericCols=self.getOrDefault(self.numericCols), categoricalCols=texts, outputCol=self.getOrDefault(self.outputCol),
            widths=[sizes[c] for c in texts],
        )
        return model


class SparseAssemblerModel(Model, _SparseParams, MLReadable, MLWritable):
    """Fitted dictionary: ``ranks`` is a DataFrame ``column, value, rank``."""

    widths = Param(Params._dummy(), "widths", "categories per text input", TypeConverters.toListInt)

    def __init__(self, ranks: DataFrame | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self.ranks = ranks

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric, texts, sizes = (self.getOrDefault(p) for p in (self.numericCols, self.categoricalCols, self.widths))
        names = {c: f"__rank{i}" for i, c in enumerate(texts)}
        rows = with_ranks(dataset, self.ranks, names, dict.fromkeys(texts, -1))
        first, hits = len(numeric), []
        for name, size in zip(names.values(), sizes, strict=True):
            hits.append(F.when(F.col(name) >= 0, F.col(name) + first))
            first += size
        ones = F.filter(F.array(*hits).cast("array<bigint>"), lambda i: i.isNotNull())
        numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]).cast("array<double>")
        places = F.array(*[F.lit(i) for i in range(len(numeric))]).cast("array<bigint>")
        row = F.struct(
            F.lit(first).cast("bigint").alias("size"), F.concat(places, ones).alias("indices"),
            F.concat(numbers, F.transform(ones, lambda _: F.lit(1.0))).alias("values"),
        )
        return rows.withColumn(self.getOrDefault(self.outputCol), row).drop(*names.values())

    def write(self) -> MLWriter:
        return _SparseWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SparseReader()


class _SparseWriter(MLWriter):
    def __init__(self, model: SparseAssemblerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.ranks.write.parquet(f"{path}/ranks")


class _SparseReader(MLReader):
    def load(self, path: str) -> SparseAssemblerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = SparseAssemblerModel(self.sparkSession.read.parquet(f"{path}/ranks"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def check_category_widths(df: DataFrame, roles: Roles, limit: int = 1_000_000) -> None:
    """Raise when a one-hot dictionary would not fit the driver.

    The label list of ``encoding_stages`` is held by the driver and shipped to every task;
    the tree model identifies categories by hash instead and has no such limit.
    """
    if not roles.categorical:
        return
    widths = df.agg(*[F.approx_count_distinct(c).alias(c) for c in roles.categorical]).first()
    wide = {c: widths[c] for c in roles.categorical if widths[c] > limit}
    if wide:
        raise ContractError(f"too many categories for a one-hot dictionary: {wide}")


def rate_model(df: DataFrame, regressor, encode: bool = False) -> Pipeline:
    """Preprocessing and regressor as one fit/transform unit, roles taken from ``df``.

    ``encode=True`` adds the sparse one-hot vector for regressors that read ``features``.
    """
    roles = column_roles(df.schema)
    if encode:
        check_category_widths(df, roles)
    stages = imputation_stages(roles) + (encoding_stages(roles) if encode else [])
    return Pipeline(stages=[*stages, regressor])


def labelled(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows usable for training: the target is present."""
    return df.where(F.col(target).isNotNull())
