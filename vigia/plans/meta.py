"""Frames with metadata: the stage that a table has reached, what it holds, and what was done to it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from enum import IntEnum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

SYSTEMS = ("SIM", "SIH", "SIA", "SINAN", "CNES", "SINASC")
_KEY = "vigia"


class Stage(IntEnum):
    """Stages in the order in which a table passes them."""

    IMPORT = 0
    CLEAN = 1
    STAND = 2
    FILTER_CID = 3
    FILTER_DEMO = 4
    DERIVE = 5
    AGGREGATE = 6
    SPATIAL = 7
    CENSUS = 8
    CLIMATE = 9


#: Types of records that a stage can't take.
UNSUPPORTED = {Stage.DERIVE: ("SIH-SP", "SIH-RJ", "SIH-ER", "CNES", "CNES-LT", "CNES-ST", "CNES-DC", "CNES-EQ", "CNES-SR", "CNES-HB", "CNES-PF", "CNES-EP", "CNES-RC", "CNES-IN", "CNES-EE", "CNES-EF", "CNES-GM")}


@dataclass(frozen=True)
class Meta:
    system: str | None = None
    stage: Stage = Stage.IMPORT
    type: str | None = None
    spatial: bool = False
    temporal: dict = field(default_factory=dict)
    history: tuple[str, ...] = ()
    user: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.system is not None and self.system not in SYSTEMS:
            raise ValueError(f"unknown system: {self.system}; one of {', '.join(SYSTEMS)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"stage": self.stage.name})

    @staticmethod
    def from_json(text: str) -> Meta:
        raw = json.loads(text)
        return Meta(**raw | {"stage": Stage[raw["stage"]], "history": tuple(raw["history"])})


@dataclass(frozen=True)
class HealthFrame:
    """A DataFrame and its Meta; both are immutable and lazy."""

    df: DataFrame
    meta: Meta = Meta()

    def step(self, name: str, make: Callable[[DataFrame], DataFrame], stage: Stage | None = None, **changes) -> HealthFrame:
        """Apply a step; a stage never goes back, and some types of records have no columns for some stages."""
        if stage is not None and self.meta.type in UNSUPPORTED.get(stage, ()):
            raise ValueError(f"{name}: records of type {self.meta.type} don't have stage {stage.name}")
        if stage is not None and stage < self.meta.stage:
            raise ValueError(f"{name} belongs to stage {stage.name}, but the table is at {self.meta.stage.name}")
        return HealthFrame(make(self.df), replace(self.meta, stage=self.meta.stage if stage is None else stage, history=(*self.meta.history, name), **changes))

    def require(self, stage: Stage) -> HealthFrame:
        if self.meta.stage < stage:
            raise ValueError(f"needs stage {stage.name}, the table is at {self.meta.stage.name}")
        return self

    def union(self, other: HealthFrame) -> HealthFrame:
        """Rows of both, columns by name; the metadata of the first."""
        return HealthFrame(self.df.unionByName(other.df, allowMissingColumns=True), self.meta)

    def write(self, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
        """Parquet whose schema carries the metadata (on its first column)."""
        first = self.df.columns[0]
        tagged = self.df.withMetadata(first, {_KEY: self.meta.to_json()})
        writer = tagged.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read(spark, path: str) -> HealthFrame:
    df = spark.read.parquet(path)
    tags = [f.metadata[_KEY] for f in df.schema.fields if _KEY in (f.metadata or {})]
    return HealthFrame(df, Meta.from_json(tags[0]) if tags else Meta())


def export(frame: HealthFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Write as csv, json or orc at ``path``, with the metadata as one JSON line at ``path``_meta."""
    from ..sources.tables import write_records

    write_records(frame.df, path, kind, mode)
    spark = frame.df.sparkSession
    spark.createDataFrame([(frame.meta.to_json(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}_meta")


def read_export(spark, path: str, **options) -> HealthFrame:
    """What ``export`` wrote; a table without metadata gets empty ones."""
    from ..sources.tables import read_records

    df = read_records(spark, path, **options)
    try:
        text = spark.read.text(f"{path}_meta").first()
    except AnalysisException:  # no such path
        text = None
    return HealthFrame(df, Meta.from_json(text[0]) if text else Meta())
