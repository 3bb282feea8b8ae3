"""Experiment files: parsed and checked on the driver, then a DataFrame of experiments."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BORDERS, FORMATS, DEVICES = ("wall", "torus"), ("gif", "frames"), ("cpu", "cuda", "mps")


class ConfigError(ValueError):
    """An experiment file that cannot be used; the message names the experiment and the field."""


@dataclass(frozen=True)
class Source:
    archive_dir: str
    run_id: str
    n: int
    creature_id: str | None = None
    cell: tuple[int, int, int] | None = None
    patch: int | None = None


@dataclass(frozen=True)
class Experiment:
    name: str
    grid_h: int
    grid_w: int
    steps: int
    snapshot_every: int
    border: str
    output_format: str
    device: str
    min_dist: int
    patch: int
    seed: int
    sources: tuple[Source, ...] = field(default=())

    @property
    def mode(self) -> str:
        return "homogeneous" if len(self.sources) == 1 else "heterogeneous"


class Fields:
    """Checked access to a mapping, with its place in the file for messages."""

    def __init__(self, raw: Any, place: str):
        if not isinstance(raw, dict):
            raise ConfigError(f"{place}: must be a mapping, got {type(raw).__name__}")
        self.raw, self.place = raw, place

    def get(self, key: str) -> Any:
        if key not in self.raw:
            raise ConfigError(f"{self.place}: missing required key {key!r}")
        return self.raw[key]

    def whole(self, key: str, least: int = 1, value: Any = None) -> int:
        v = self.get(key) if value is None else value
        if isinstance(v, bool) or not isinstance(v, int):
            raise ConfigError(f"{self.place}: {key!r} must be an integer, got {type(v).__name__}")
        if v < least:
            raise ConfigError(f"{self.place}: {key!r} must be at least {least}, got {v}")
        return v

    def text(self, key: str, default: str | None = None) -> str:
        v = self.raw.get(key, default) if default is not None else self.get(key)
        if not isinstance(v, str) or not v.strip():
            raise ConfigError(f"{self.place}: {key!r} must be a non-empty string")
        return v

    def one_of(self, key: str, allowed: tuple[str, ...]) -> str:
        v = self.get(key)
        if v not in allowed:
            raise ConfigError(f"{self.place}: {key!r} must be one of {allowed}, got {v!r}")
        return v

    def items(self, key: str, size: int | None = None) -> list:
        v = self.get(key)
        if not isinstance(v, list) or not v or (size and len(v) != size):
            raise ConfigError(f"{self.place}: {key!r} must be a list" + (f" of {size}" if size else " with an entry"))
        return v


def parse(document: Any, archive_dir: str = "archive", device: str = "cpu") -> list[Experiment]:
    """The experiments of a parsed file; names are unique."""
    if device not in DEVICES:
        raise ConfigError(f"device {device!r} not in {DEVICES}")
    out: list[Experiment] = []
    for i, raw in enumerate(Fields(document, "file").items("experiments")):
        name = Fields(raw, f"experiments[{i}]").text("name")
        f = Fields(raw, f"experiment {name!r}")
        grid = f.get("grid")
        side = f.items("grid", 2) if isinstance(grid, list) else [grid, grid]
        h, w = (f.whole("grid", value=v) if v is not None else f.whole("grid") for v in side)
        steps, every = f.whole("steps"), f.whole("snapshot_every")
        if every > steps:
            raise ConfigError(f"{f.place}: snapshot_every ({every}) cannot exceed steps ({steps})")
        spawn = Fields(f.get("spawn"), f"{f.place} spawn")
        sources = []
        for k, s in enumerate(f.items("sources")):
            g = Fields(s, f"{f.place} sources[{k}]")
            if "creature_id" not in g.raw and "cell" not in g.raw:
                raise ConfigError(f"{g.place}: must have either 'creature_id' or 'cell'")
            known = "creature_id" in g.raw
            cell = None if known else tuple(g.whole("cell", 0, v) for v in g.items("cell", 3))
            sources.append(Source(g.text("archive_dir", archive_dir), g.text("run"), g.whole("n"), g.text("creature_id") if known else None, cell, g.whole("patch") if g.raw.get("patch") is not None else None))
        out.append(Experiment(name, h, w, steps, every, f.one_of("border", BORDERS), f.one_of("output_format", FORMATS), device, spawn.whole("min_dist"), spawn.whole("patch"), spawn.whole("seed", 0), tuple(sources)))
    twice = sorted({e.name for e in out if sum(o.name == e.name for o in out) > 1})
    if twice:
        raise ConfigError(f"experiment names are not unique: {twice}")
    return out


def load(path: str, **defaults: str) -> list[Experiment]:
    import yaml

    with open(path) as f:
        try:
            document = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError(f"{path}: {e}") from e
    return parse(document, **defaults)


SCHEMA = "name string, grid_h int, grid_w int, steps int, snapshot_every int, border string, output_format string, device string, min_dist int, patch int, seed long, sources array<struct<archive_dir:string,run_id:string,n:int,creature_id:string,cell:array<int>,patch:int>>"


def experiments(spark: SparkSession, parsed: list[Experiment]) -> DataFrame:
    rows = [asdict(e) for e in parsed]
    for r in rows:
        r["sources"] = [{**s, "cell": list(s["cell"]) if s["cell"] else None} for s in r["sources"]]
    return spark.createDataFrame(rows, SCHEMA).withColumn("mode", F.when(F.size("sources") == 1, "homogeneous").otherwise("heterogeneous"))


def with_sources(frame: DataFrame, archive: DataFrame) -> DataFrame:
    """One row per experiment and source, with its creature; ``found`` says whether the archive has it.

    A source names its creature, or in older files the coordinates of a cell of
    its run, where the archive has columns run_id and coordinates.
    """
    rows = frame.select("name", "patch", F.posexplode("sources").alias("species", "source")).select("name", "species", "source.run_id", "source.creature_id", "source.cell", "source.n", F.coalesce("source.patch", "patch").alias("patch"))
    if "coordinates" in archive.columns:
        by_cell = archive.select(F.col("run_id").alias("_run"), F.col("coordinates").alias("_cell"), F.col("creature_id").alias("_creature"))
        rows = rows.join(by_cell, rows["creature_id"].isNull() & (rows["run_id"] == by_cell["_run"]) & (rows["cell"] == by_cell["_cell"]), "left").withColumn("creature_id", F.coalesce("creature_id", "_creature")).drop("_run", "_cell", "_creature")
    own = archive.drop("run_id", "coordinates", "cell", "name", "species", "n", "patch").withColumn("found", F.lit(True))
    return rows.drop("cell").join(own, "creature_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def require_found(sources: DataFrame) -> DataFrame:
    """``sources`` of with_sources(); an error that lists creatures which no archive has."""
    lost = [f"{r['name']}[{r['species']}]: {r['creature_id'] or 'no creature in that cell'}" for r in sources.where("not found").select("name", "species", "creature_id").orderBy("name", "species").limit(20).collect()]
    if lost:
        raise ConfigError(f"not in the archive: {lost}")
    return sources


def signal_consistency(sources: DataFrame) -> DataFrame:
    """Experiments whose sources mix creatures with and without signals, or differ in kernels."""
    has = F.col("has_signal")
    return sources.groupBy("name").agg((F.bool_or(has) & ~F.bool_and(has)).alias("mixed_signal"), (F.count_distinct("kernels") > 1).alias("mixed_kernels")).where("mixed_signal or mixed_kernels")
