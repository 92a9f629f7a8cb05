"""Case tables as CSV, and whole sessions as Parquet with a JSON sidecar."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.plans.stats import parsed

#: Cells that stand for a missing value.
MISSING = ("", ".", "NA")


def read_csv(spark: SparkSession, path: str, case_id: str = "id") -> DataFrame:
    """A CSV file with a header as typed cases: doubles where every cell is a number, else strings.

    Cells are trimmed; empty, ``.`` and ``NA`` are null; a column without any value is
    numeric. ``case_id`` numbers the rows in file order: consecutive within the file, from
    the counts of Spark's partitions, so no task sees more than its own part. Measure,
    label and decimals are kept as field metadata.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(path, inferSchema=False)
    clean = raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.trim(F.col(f"`{c}`"))).alias(c) for c in raw.columns))
    bad = clean.agg(*(F.max((F.col(f"`{c}`").isNotNull() & parsed(F.col(f"`{c}`")).isNull()).cast("int")).alias(str(i)) for i, c in enumerate(clean.columns))).first() if clean.columns else []
    cols = []
    for i, c in enumerate(clean.columns):
        text = bool(bad[i])
        meta = {"label": "", "measure": "Nominal" if text else "Scale", "role": "Input", "dec": 0 if text else 2, "width": 8}
        cols.append((F.col(f"`{c}`") if text else parsed(F.col(f"`{c}`"))).alias(c, metadata=meta))
    return number_cases(clean.select(*cols), case_id)


def number_cases(df: DataFrame, case_id: str = "id", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in its present order: one small row for each partition shifts the rest."""
    at = df.withColumn("__m", F.monotonically_increasing_id())
    at = at.withColumn("__p", F.shiftright("__m", 33))
    size = at.groupBy("__p").agg(F.count("*").alias("k"))
    before = size.select("__p", (F.coalesce(F.sum("k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("__b"))
    out = at.join(F.broadcast(before), "__p").withColumn(case_id, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.select(case_id, *(F.col(f"`{c}`") for c in df.columns if c != case_id))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; strings quoted, quotes doubled, null as ``.``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = [F.coalesce(quoted(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`").cast("string"), F.lit(".")) for f in df.schema]
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # each part file starts with the header, as Spark's own CSV writer does it
    rows = df.select(F.concat_ws(",", *line).alias(head))
    rows.write.option("header", True).option("quote", "").option("quoteAll", False).option("escapeQuotes", False).option("sep", "\u0001").csv(path)


def save_session(frames: dict[str, DataFrame], path: str, active: str | None = None) -> None:
    """Each named table as Parquet (field metadata included), and a JSON line that lists them."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if frames:
        spark = next(iter(frames.values())).sparkSession
        note = json.dumps({"datasets": list(frames), "active": active or next(iter(frames))})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/session-note")


def open_session(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], str]:
    """(tables by name, name of the active one); each table also becomes a temporary view."""
    note = json.loads(spark.read.text(f"{path}/session-note").first()[0])
    frames = {name: spark.read.parquet(f"{path}/{name}") for name in note["datasets"]}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return frames, note["active"]


def rename_dataset(spark: SparkSession, old: str, new: str) -> None:
    spark.table(old).createOrReplaceTempView(new)
    spark.catalog.dropTempView(old)


class Datasets:
    """Named tables in one shared folder, one of them active; every driver that opens the folder sees the same.

    The catalogue is a JSON line in a folder of its own version. A change writes the table first
    and the next version last, so a driver lost in between leaves the old catalogue in force. Of
    two drivers that change it at once the second fails, as its version is already there. Names
    are unique, any text; a rename moves no data; the last dataset can't be deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict]:
        at = self._hadoop(f"{self.path}/catalogue")
        whole = [int(f.getPath().getName()) for f in self._files.listStatus(at) if self._files.exists(self._hadoop(f"{f.getPath()}/_SUCCESS"))] if self._files.exists(at) else []
        if not whole:
            return 0, {"active": None, "folders": {}}
        return max(whole), json.loads(self.spark.read.text(f"{self.path}/catalogue/{max(whole):08d}").first()[0])

    def _commit(self, version: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/catalogue/{version + 1:08d}")

    def names(self) -> list[str]:
        return list(self._state()[1]["folders"])

    def active(self) -> str | None:
        return self._state()[1]["active"]

    def get(self, name: str | None = None) -> DataFrame:
        """The named table, or the active one."""
        state = self._state()[1]
        return self.spark.read.parquet(f"{self.path}/tables/{state['folders'][state['active'] if name is None else name]}")

    def add(self, name: str, df: DataFrame) -> None:
        """Write ``df`` as a new dataset and make it active."""
        self._put(name, df, new=True)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write ``df``, which may be made from the dataset itself, in its place; the old table stays until ``vacuum``."""
        self._put(name, df, new=False)

    def _put(self, name: str, df: DataFrame, new: bool) -> None:
        version, state = self._state()
        if (name in state["folders"]) == new:
            raise ValueError(f"dataset {name!r} {'exists' if new else 'is not there'}")
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/tables/{folder}")
        state["folders"][name] = folder
        self._commit(version, state | ({"active": name} if new else {}))

    def switch(self, name: str) -> None:
        version, state = self._state()
        if name not in state["folders"]:
            raise KeyError(name)
        if state["active"] != name:
            self._commit(version, state | {"active": name})

    def rename(self, old: str, new: str) -> None:
        version, state = self._state()
        if new != old and new in state["folders"]:
            raise ValueError(f"dataset {new!r} exists")
        folders = {new if n == old else n: f for n, f in state["folders"].items()}
        if old not in state["folders"]:
            raise KeyError(old)
        self._commit(version, {"active": new if state["active"] == old else state["active"], "folders": folders})

    def delete(self, name: str) -> None:
        """Take the dataset out of the catalogue; if it was active, the first one becomes active."""
        version, state = self._state()
        folders = {n: f for n, f in state["folders"].items() if n != name}
        if name not in state["folders"]:
            raise KeyError(name)
        if not folders:
            raise ValueError("at least one dataset stays")
        self._commit(version, {"active": next(iter(folders)) if state["active"] == name else state["active"], "folders": folders})

    def vacuum(self) -> None:
        """Delete tables that the catalogue no longer names; call it when nobody reads or writes them."""
        named, at = set(self._state()[1]["folders"].values()), self._hadoop(f"{self.path}/tables")
        for f in self._files.listStatus(at) if self._files.exists(at) else []:
            if f.getPath().getName() not in named:
                self._files.delete(f.getPath(), True)
