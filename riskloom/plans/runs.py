"""Runs on disk: the tables, models and settings of a training run in one folder.

Everything is written first, and the manifest last: it names each part with its rows, its schema and a
fingerprint of its content. A folder without a manifest is a run that was not finished, and is refused; parts that no
longer match it are refused too. Deployment starts from such a folder alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DEPLOY_THRESHOLD
from riskloom.operators.explain import forest_nodes
from riskloom.plans.materialise import stored
from riskloom.plans.training import TrainedModels, TrainingResult, deploy, run_line
from riskloom.sources import stores

MANIFEST_SCHEMA = "name string, kind string, place string, rows long, fingerprint string, columns string"


class RunError(Exception):
    """A folder that holds no whole run."""


@dataclass
class SavedRun:
    """A finished run: its folder and its manifest."""

    spark: SparkSession
    path: str
    manifest: DataFrame

    def table(self, name: str) -> DataFrame:
        """One of the run's tables."""
        found = self.manifest.where((F.col("name") == name) & (F.col("kind") == "table")).first()
        if found is None:
            raise RunError(f"{self.path} has no table {name}")
        return self.spark.read.schema(found["columns"]).parquet(f"{self.path}/{found['place']}")

    def models(self) -> TrainedModels:
        """The run's fitted models."""
        return TrainedModels(
            stores.load_forest(f"{self.path}/models/forest"), stores.load_isolation(self.spark, f"{self.path}/models/isolation"),
            stores.load_envelope(self.spark, f"{self.path}/models/envelope"),
        )


def fingerprint(table: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of hashes of whole rows: the same for the same rows in any order and layout."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)")
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).alias("s")).first()
    return row["n"], f"{int(row['s']) % (1 << 64):016x}"


def _model_tables(spark: SparkSession, path: str, models: TrainedModels) -> dict[str, DataFrame]:
    """Tables that say what each model is, for its fingerprint."""
    return {
        "forest": forest_nodes(spark.range(0), models.forest).select("tree", "node", "feature", "threshold", "left", "right", "value"),
        "isolation": spark.read.parquet(f"{path}/models/isolation/nodes"),
        "envelope": spark.read.parquet(f"{path}/models/envelope").select(
            F.to_json(F.struct("*")).alias("settings")
        ),
    }


def _columns(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)


def has_manifest(spark: SparkSession, path: str) -> bool:
    """Whether a run was finished in the folder."""
    try:
        return not spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest").isEmpty()
    except AnalysisException:
        return False


def save_run(result: TrainingResult, path: str) -> SavedRun:
    """Write a run; its manifest, written last, makes it one. A folder that holds a run is refused."""
    spark = result.days.sparkSession
    if has_manifest(spark, path):
        raise RunError(f"{path} holds a run already")
    parts = []
    for name, table in {**result.tables(), "run": run_line(result)}.items():
        place = f"tables/{name}"
        table.write.mode("overwrite").parquet(f"{path}/{place}")
        written = spark.read.schema(table.schema).parquet(f"{path}/{place}")
        parts.append((name, "table", place, *fingerprint(written), _columns(table)))
    models = result.models
    stores.save_forest(models.forest, f"{path}/models/forest")
    stores.save_isolation(models.isolation, f"{path}/models/isolation")
    stores.save_envelope(spark, models.envelope, f"{path}/models/envelope")
    for name, table in _model_tables(spark, path, models).items():
        parts.append((name, "model", f"models/{name}", *fingerprint(table), _columns(table)))
    spark.createDataFrame(parts, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return open_run(spark, path)


def open_run(spark: SparkSession, path: str, verify: bool = False) -> SavedRun:
    """A finished run. ``verify`` reads every part and compares it with the manifest."""
    if not has_manifest(spark, path):
        raise RunError(f"{path} holds no finished run: it has no manifest")
    run = SavedRun(spark, path, spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest"))
    if verify:
        try:
            models = _model_tables(spark, path, run.models())
            for part in run.manifest.collect():  # a row per part
                table = run.table(part["name"]) if part["kind"] == "table" else models[part["name"]]
                if fingerprint(table) != (part["rows"], part["fingerprint"]):
                    raise RunError(f"{path}: {part['kind']} {part['name']} is not what the run wrote")
        except (AnalysisException, OSError) as error:
            raise RunError(f"{path}: {error}") from error
    return run


def deploy_run(
    run: SavedRun, days: DataFrame, threshold: float | None = None, override: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score days with a saved run: scored days, user report and attributions.

    The detector's range comes from the run. The threshold is the one given, else with ``override`` the run's
    recommended one, else the fixed one.
    """
    limits = run.table("thresholds").first()  # one row
    if threshold is None:
        threshold = limits["recommended_threshold"] if override else DEPLOY_THRESHOLD
    return deploy(days, run.models(), (limits["iso_score_min"], limits["iso_score_max"]), threshold)


def rows_by_part(run: SavedRun) -> DataFrame:
    """Rows of each table as the manifest has them and as the folder holds them now."""
    parts = run.manifest.where("kind = 'table'").select("name", "rows").collect()
    now = None
    for part in parts:
        one = run.table(part["name"]).agg(F.count(F.lit(1)).alias("rows_now")).select(
            F.lit(part["name"]).alias("name"), F.lit(part["rows"]).alias("rows"), "rows_now"
        )
        now = one if now is None else now.unionByName(one)
    return stored(now, "run-parts")
