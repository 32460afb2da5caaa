"""A durable registry of models and datasets, kept in one folder.

Below the folder are the saved models (``models/<id>``), the data of registered
datasets (``tables/<id>``, each also a table of the session's catalog, written by
``saveAsTable``) and an append-only log, a Parquet table with a row per event:
added, renamed, selected, deleted. What is there, and which entry is active, is
read off the log, so a later session lists, selects, loads and deletes what an
earlier one kept, whatever its catalog remembers.

Names are unique per kind; a taken one gets ``_2``, ``_3``, ... Of two sessions
that add under one name at once, the event that is earlier by time and id holds
it and the other entry goes by the next free name. Files are written before the
event that names them, so a session that dies in between leaves files that
:meth:`Registry.sweep` deletes.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.train import TrainedModel, load_model, save_model
from ..session import list_names, path_exists, remove_path
from .catalog import unique_name

MODEL, DATASET = "model", "dataset"
_LOG = "event string, at timestamp, action string, kind string, entry string, name string, detail string"


@dataclass(frozen=True)
class Entry:
    kind: str
    entry: str   # id, unchanging
    name: str    # unique among those of its kind
    logged: str  # the name that the log has for it
    detail: dict


class Registry:
    """Models and datasets in ``folder``; ``database`` is where the tables of
    datasets are registered."""

    def __init__(self, spark: SparkSession, folder: str, database: str = "default"):
        self.spark, self.folder, self.database = spark, folder.rstrip("/"), database

    # ------------------------------------------------------------- the log --

    def log(self) -> DataFrame:
        """All events, unordered."""
        path = f"{self.folder}/log"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(path)

    def _append(self, action: str, kind: str, entry: str, name: str = "", detail: dict | None = None) -> None:
        row = (uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc), action, kind, entry, name, json.dumps(detail or {}))
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _events(self, kind: str) -> list:
        """Events of one kind in order. They are as many as people's actions."""
        return self.log().where(F.col("kind") == kind).orderBy("at", "event").collect()

    # ------------------------------------------------------------- entries --

    def entries(self, kind: str = MODEL) -> list[Entry]:
        """What is there, in the order of addition."""
        events = self._events(kind)
        gone = {e["entry"] for e in events if e["action"] == "delete"}
        renamed = {e["entry"]: e["name"] for e in events if e["action"] == "rename"}
        out: list[Entry] = []
        for e in events:
            if e["action"] == "add" and e["entry"] not in gone:
                logged = renamed.get(e["entry"], e["name"])
                name = unique_name(logged, [x.name for x in out])
                out.append(Entry(kind, e["entry"], name, logged, json.loads(e["detail"])))
        return out

    def names(self, kind: str = MODEL) -> list[str]:
        return sorted((e.name for e in self.entries(kind)), key=str.casefold)

    def find(self, kind: str, name: str) -> Entry:
        for e in self.entries(kind):
            if e.name == name:
                return e
        raise ValueError(f"There is no {kind} named {name!r} in {self.folder}.")

    def select(self, kind: str, name: str) -> Entry:
        """Make an entry the active one of its kind, for later sessions too."""
        found = self.find(kind, name)
        self._append("select", kind, found.entry)
        return found

    def active(self, kind: str = MODEL) -> Entry | None:
        """Of the entries still there, the one added or selected last."""
        there = {e.entry: e for e in self.entries(kind)}
        chosen = [e["entry"] for e in self._events(kind) if e["action"] in ("add", "select") and e["entry"] in there]
        return there[chosen[-1]] if chosen else None

    def delete(self, kind: str, name: str) -> None:
        """Forget an entry and delete its files; all other names stay."""
        found = self.find(kind, name)
        for e in self.entries(kind):
            if e.name != e.logged:
                self._append("rename", kind, e.entry, e.name)
        self._append("delete", kind, found.entry)
        if kind == DATASET:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(found)}")
        remove_path(self.spark, self._path(kind, found.entry))

    def sweep(self) -> list[str]:
        """Delete files that no event names, left by sessions that died; not to
        be called while another session adds. Returns their ids."""
        named = {r["entry"] for r in self.log().where("action = 'add'").select("entry").collect()}
        lost = [(k, n) for k in (MODEL, DATASET) for n in list_names(self.spark, f"{self.folder}/{k}s") if n not in named]
        for kind, entry in lost:
            remove_path(self.spark, self._path(kind, entry))
        return sorted(entry for _, entry in lost)

    def _path(self, kind: str, entry: str) -> str:
        return f"{self.folder}/{kind}s/{entry}"

    def _added(self, kind: str, entry: str, base: str, detail: dict) -> str:
        self._append("add", kind, entry, unique_name(base.strip() or kind.title(), self.names(kind)), detail)
        return next(e.name for e in self.entries(kind) if e.entry == entry)

    # -------------------------------------------------------------- models --

    def add_model(self, model: TrainedModel, base: str | None = None) -> str:
        """Save a model; it becomes the active one. Returns its unique name."""
        entry = uuid.uuid4().hex
        save_model(model, self._path(MODEL, entry))
        return self._added(MODEL, entry, base or model.model_name, {
            "model_name": model.model_name, "task_type": model.task_type, "target": model.target,
            "features": list(model.features), "metrics": model.metrics})

    def load_model(self, name: str | None = None, continuable: bool = False) -> TrainedModel:
        """A model by name (the active one if None)."""
        found = self.find(MODEL, name) if name else self.active(MODEL)
        if found is None:
            raise ValueError(f"There is no model in {self.folder}.")
        return load_model(self.spark, self._path(MODEL, found.entry), continuable)

    def models(self) -> DataFrame:
        """``name, model_name, task_type, target, features, active``: a row per model."""
        active = self.active(MODEL)
        rows = [(e.name, e.detail["model_name"], e.detail["task_type"], e.detail["target"], e.detail["features"],
                 active is not None and e.entry == active.entry) for e in self.entries(MODEL)]
        return self.spark.createDataFrame(
            rows, "name string, model_name string, task_type string, target string, features array<string>, active boolean")

    # ------------------------------------------------------------ datasets --

    def add_dataset(self, df: DataFrame, base: str, replace: bool = False) -> str:
        """Write a dataset and register its table; returns its unique name (that
        of the one it replaces, if ``replace``)."""
        entry = uuid.uuid4().hex
        table = f"ds_{re.sub(r'[^0-9A-Za-z]', '_', base)[:80].lower()}_{entry[:8]}"
        (df.write.format("parquet").option("path", self._path(DATASET, entry))
         .saveAsTable(f"`{self.database}`.`{table}`"))
        if replace and base in self.names(DATASET):
            self.delete(DATASET, base)
        return self._added(DATASET, entry, base, {"table": table, "columns": [str(c) for c in df.columns]})

    def _table(self, entry: Entry) -> str:
        return f"`{self.database}`.`{entry.detail['table']}`"

    def table(self, name: str) -> str:
        """SQL name of a dataset, registered anew where this session's catalog
        does not have it."""
        found = self.find(DATASET, name)
        if not self.spark.catalog.tableExists(self._table(found)):
            self.spark.catalog.createTable(self._table(found), self._path(DATASET, found.entry), "parquet")
        return self._table(found)

    def dataset(self, name: str | None = None) -> DataFrame:
        """A dataset by name (the active one if None)."""
        if name is None:
            active = self.active(DATASET)
            if active is None:
                raise ValueError(f"There is no dataset in {self.folder}.")
            name = active.name
        return self.spark.table(self.table(name))
