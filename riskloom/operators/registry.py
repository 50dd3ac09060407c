"""Versioned models, an atomically moved pointer, rollback and a run log (the retraining cycle).

A registry is a folder in shared storage (by default under `spark.checkpoint.dir`):

* `versions/v<time>-<id>/`: one saved MLlib model a version, never changed once written;
* `pointer/`: an append-only table of (seq, version, at); the current model is the row of the
  largest seq. Moving the pointer appends one row, which a Spark job commits as a whole, so a
  reader sees the old or the new pointer and never a half-written one, and every earlier state
  stays on record for rollback;
* `log/`: an append-only table of runs (seq, at, action, reason, urgency, old_auc, new_auc,
  improvement, version_before, version_after). Actions: skip, replaced, kept, failed, rollback,
  rollback_failed.

`retrain_cycle` follows a decision row (`retrain_needed`, `urgency`, `action` of
`drift.retrain_decision`): without need it logs a skip; otherwise it fits on train plus validation
rows, scores old and new model on the holdout, and moves the pointer to the new version only if
`drift.better_model` says so (higher AUC, or equal AUC within 0.001 and higher F1). A failing fit
is logged, not raised. `rollback` moves the pointer back to the version before the current one (or
to a named one) and logs it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_dir

LOG = "seq long, at timestamp, action string, reason string, urgency string, old_auc double, new_auc double, improvement double, version_before string, version_after string"
POINTER = "seq long, version string, at timestamp"


class Registry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{scratch_dir(spark)}/riskloom/registry-{uuid.uuid4().hex}"

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception:  # noqa: BLE001 - no file yet: an empty table
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def pointers(self) -> DataFrame:
        return self._table("pointer", POINTER)

    def current(self) -> str | None:
        row = self.pointers().orderBy(F.desc("seq")).select("version").first()
        return row[0] if row else None

    def load(self, version: str | None = None) -> Model | None:
        version = version or self.current()
        return PipelineModel.load(f"{self.root}/versions/{version}").stages[0] if version else None

    def save(self, model: Model) -> str:
        """Write a new version folder; the pointer does not move."""
        version = f"v{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        PipelineModel([model]).write().save(f"{self.root}/versions/{version}")
        return version

    def point(self, version: str) -> None:
        seq = (self.pointers().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, version, dt.datetime.now(dt.UTC).replace(tzinfo=None))], POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def record(self, **entry) -> dict:
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        names = [f.split()[0] for f in LOG.split(", ")]
        row = {n: entry.get(n) for n in names} | {"seq": seq, "at": dt.datetime.now(dt.UTC).replace(tzinfo=None)}
        self.spark.createDataFrame([tuple(row[n] for n in names)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return row


def retrain_cycle(
    reg: Registry, decision: dict, fit: Callable[[DataFrame], Model], train: DataFrame, val: DataFrame, test: DataFrame,
    score: Callable[[Model, DataFrame, str], DataFrame], y: str = "y",
) -> dict:
    """One run of the cycle; returns its log row."""
    from riskloom.operators.drift import better_model

    before = reg.current()
    urgency = decision.get("urgency")
    if not decision.get("retrain_needed"):
        return reg.record(action="skip", reason=decision.get("action") or "continue_monitoring", urgency=urgency, version_before=before, version_after=before)
    try:
        new = fit(train.unionByName(val, allowMissingColumns=True))
    except Exception as e:  # noqa: BLE001 - a failed fit is a logged outcome
        return reg.record(action="failed", reason=str(e)[:500], urgency=urgency, version_before=before, version_after=before)
    if before is None:
        version = reg.save(new)
        reg.point(version)
        return reg.record(action="replaced", reason="no previous model", urgency=urgency, version_before=None, version_after=version)
    both = score(new, score(reg.load(before), test, "p_old"), "p_new")
    row = better_model(both, "p_old", "p_new", y).first()
    gain = None if row["new_auc"] is None or row["old_auc"] is None else row["new_auc"] - row["old_auc"]
    if row["new_is_better"]:
        version = reg.save(new)
        reg.point(version)
        return reg.record(action="replaced", reason="new model is better on the holdout", urgency=urgency, old_auc=row["old_auc"], new_auc=row["new_auc"], improvement=gain, version_before=before, version_after=version)
    return reg.record(action="kept", reason="new model is not better on the holdout", urgency=urgency, old_auc=row["old_auc"], new_auc=row["new_auc"], improvement=gain, version_before=before, version_after=before)


def rollback(reg: Registry, version: str | None = None) -> dict:
    """Point back to `version`, or to the version that was current before the present one."""
    before = reg.current()
    if version is None:
        earlier = reg.pointers().where(F.col("version") != F.lit(before)).orderBy(F.desc("seq")).select("version").first() if before else None
        version = earlier[0] if earlier else None
    if version is None:
        return reg.record(action="rollback_failed", reason="no earlier version", version_before=before, version_after=before)
    reg.point(version)
    return reg.record(action="rollback", reason=f"pointer moved back to {version}", version_before=before, version_after=version)
