"""Model tables on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from belegwerk.operators.bayes import Model

TABLES = {
    "vocab": "term string, df long, cf long, idf double, term_id long",
    "classes": "label_id long, label string, n_docs long, log_prior double, log_unseen double",
    "weights": "label_id long, term_id long, log_prob double, gain double",
    "matrix": "block int, label_ids array<long>, term_ids array<long>, gains array<double>, log_prior array<double>, log_unseen array<double>",
}


class ModelMissing(RuntimeError):
    """No usable model at the given place; train one first."""


def save_model(model: Model, path: str) -> None:
    for name in TABLES:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model at ``path``; each table is checked for its columns."""
    tables = {}
    for name, schema in TABLES.items():
        try:
            table = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            raise ModelMissing(f"no table {name} at {path}") from error
        wanted = [field.strip().split(" ") for field in schema.split(",")]
        missing = [column for column, _ in wanted if column not in table.columns]
        if missing:
            raise ModelMissing(f"table {name} at {path} lacks {', '.join(missing)}")
        tables[name] = table.select(*[table[column].cast(kind) for column, kind in wanted])
    return Model(**tables)
