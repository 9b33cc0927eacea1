"""What a run may be told: folders, words that name document types, thresholds. Read from one JSON object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from docassay.sources.files import LARGE_IMAGE, SMALL_OVERLAY, TYPE_WORDS


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    folders: dict[str, str] = field(default_factory=dict)
    type_words: tuple[tuple[str, tuple[str, ...]], ...] = TYPE_WORDS
    large_image_pixels: int = LARGE_IMAGE
    small_overlay_pixels: int = SMALL_OVERLAY
    fake_from: int = 25
    validation_share: float = 0.2

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        """Settings from a file in any store that Spark reads; unknown names and values of another kind are errors."""
        given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one file
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if "type_words" in given:
            given["type_words"] = tuple((kind, tuple(words)) for kind, words in given["type_words"].items())
        made, usual = cls(**given), cls()
        for f in fields(cls):
            if not isinstance(getattr(made, f.name), (type(getattr(usual, f.name)), int) if f.name == "validation_share" else type(getattr(usual, f.name))):
                raise ValueError(f"{f.name} is of another kind: {getattr(made, f.name)!r}")
        return made
