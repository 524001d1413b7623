"""A model under training as a base and a log of changes.

A step writes the coordinates that it has touched, no more: version k of the model is
the last row of each coordinate in the base and in the changes up to k. Now and then
changes are laid into a new base. A version is there once all its tables are; a step
that is run again writes the same version in the same place.

path/base-<k>/linear, path/base-<k>/factors, path/change-<k>/linear, path/change-<k>/factors
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.params import Params
from sparseloom.operators.model import FACTORS, LINEAR, Model
from sparseloom.storage import listed, remove

#: Changes that are read beside a base before a new one is made.
CHANGES = 8


@dataclass
class ModelLog:
    spark: SparkSession
    path: str
    params: Params

    @property
    def _tables(self) -> dict[str, str]:
        kind = self.params.model_type
        return {"linear": LINEAR} | ({} if kind == "LR" else {"factors": FACTORS[kind]})

    def _versions(self, part: str) -> list[int]:
        """Numbers of whole bases or changes, in order."""
        found = [int(name.removeprefix(f"{part}-")) for name in listed(self.spark, self.path) if name.startswith(f"{part}-")]
        return sorted(k for k in found if all("_SUCCESS" in listed(self.spark, f"{self.path}/{part}-{k}/{t}") for t in self._tables))

    def last(self) -> int | None:
        """The newest version, None without a base."""
        return max([*self._versions("base"), *self._versions("change")], default=None)

    def _write(self, place: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{place}/{name}")

    def start(self, model: Model, version: int = 0) -> None:
        self._write(f"base-{version}", {"linear": model.linear} | ({} if model.factors is None else {"factors": model.factors}))

    def append(self, version: int, linear: DataFrame, factors: DataFrame | None) -> None:
        """Changes of a step: whole rows of the coordinates that it touched."""
        self._write(f"change-{version}", {"linear": linear} | ({} if factors is None else {"factors": factors}))

    def read(self, version: int | None = None) -> Model:
        """The model of a version, the newest one by default."""
        version = self.last() if version is None else version
        bases = [k for k in self._versions("base") if version is not None and k <= version]
        if not bases:
            raise ValueError(f"{self.path} has no version {version}")
        base, changes = bases[-1], [k for k in self._versions("change") if bases[-1] < k <= version]
        if base != version and (not changes or changes[-1] != version):
            raise ValueError(f"{self.path} has no version {version}")
        out = {}
        for name, schema in self._tables.items():
            part = lambda place: self.spark.read.schema(schema).parquet(f"{self.path}/{place}/{name}")  # noqa: B023, E731
            out[name] = part(f"base-{base}")
            if changes:
                key = [c for c in ("feat", "field") if c in out[name].columns]
                rest = [c for c in out[name].columns if c not in key]
                every = out[name].withColumn("_k", F.lit(base))
                for k in changes:
                    every = every.unionByName(part(f"change-{k}").withColumn("_k", F.lit(k)))
                newest = every.groupBy(*key).agg(F.max_by(F.struct(*rest), "_k").alias("_row"))
                out[name] = newest.select(*key, "_row.*")
        return Model(self.params, out["linear"], out.get("factors"))

    def forget(self, oldest: int) -> None:
        """Remove what versions from oldest on don't need."""
        bases, changes = self._versions("base"), self._versions("change")
        base = max((k for k in bases if k <= oldest), default=0)
        for part, versions in (("base", bases), ("change", changes)):
            for k in versions:
                if k < base or part == "change" and k <= base:
                    remove(self.spark, f"{self.path}/{part}-{k}")

    def compact(self) -> None:
        """A new base from the newest version once there are many changes. The version before stays readable, as its step may be run again."""
        newest, base = self.last(), max(self._versions("base"), default=0)
        if newest is not None and len([k for k in self._versions("change") if k > base]) >= CHANGES:
            self.start(self.read(newest), newest)
            self.forget(newest - 1)
