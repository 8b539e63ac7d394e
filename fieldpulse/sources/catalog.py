"""Datasets by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fieldpulse import schemas
from fieldpulse.sources.files import read_csv, read_parquet, read_prefix
from fieldpulse.sources.incremental import load_changed


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies below the root folder and how to read it."""

    path: str
    schema: StructType | None = None
    prefix: str | None = None

    def load(self, spark: SparkSession, root: str) -> DataFrame:
        location = f"{root.rstrip('/')}/{self.path}".rstrip("/")
        if self.prefix:
            return read_prefix(spark, location, self.prefix, "csv", self.schema)
        if self.schema is None:
            return read_parquet(spark, location)
        return read_csv(spark, location, self.schema)


# File names of the source data.
DATASETS: dict[str, Dataset] = {
    "plays": Dataset("PlayList.csv", schemas.PLAYS),
    "injuries": Dataset("InjuryRecord.csv", schemas.INJURIES),
    "tracking": Dataset("PlayerTrackData.csv", schemas.TRACKING),
    "role_data": Dataset("play_player_role_data.csv", schemas.ROLE_DATA),
    "punt_data": Dataset("player_punt_data.csv", schemas.PUNT_DATA),
    "play_information": Dataset("play_information.csv", schemas.PLAY_INFORMATION),
    "game_data": Dataset("game_data.csv", schemas.GAME_DATA),
    "video_review": Dataset("video_review.csv", schemas.VIDEO_REVIEW),
    "ngs": Dataset("", schemas.NGS, prefix="NGS-"),
    "qualitative_injuries": Dataset("qualitative_injuries.parquet"),
    "qualitative_concussions": Dataset("qualitative_concussions.parquet"),
}


@dataclass(frozen=True)
class Catalog:
    """A root folder and the datasets below it."""

    root: str
    datasets: Mapping[str, Dataset] = field(default_factory=lambda: DATASETS)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.datasets:
            raise ValueError(f"unknown dataset {name!r}, expected one of {sorted(self.datasets)}")
        return self.datasets[name].load(spark, self.root)

    def land(self, spark: SparkSession, name: str, out: str) -> list[str]:
        """Load the changed files of a dataset made of many into Parquet; their names."""
        found = self.datasets[name]
        if not found.prefix or found.schema is None:
            raise ValueError(f"{name!r} is not a dataset of many files")
        location = f"{self.root.rstrip('/')}/{found.path}".rstrip("/")
        return load_changed(spark, location, found.prefix, found.schema, out)
