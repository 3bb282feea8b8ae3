"""Commands: python -m tessella search | ecosystem | doctor."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import subprocess
import sys
import time
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import functions as F

from tessella.operators import archive as AR
from tessella.operators import descriptors as D
from tessella.operators import ownership as O
from tessella.operators.search import CALIBRATION, SIGNAL_CALIBRATION, SearchConfig, eta, search
from tessella.operators.simulation import PRESETS, ecosystem_histories, ecosystems, preset, trajectories, world_of
from tessella.session import session
from tessella.sources import config as C
from tessella.sources import tables as T


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    s = commands.add_parser("search", help="search a world for an archive of different creatures")
    s.add_argument("--preset", choices=sorted(PRESETS), default="standard")
    s.add_argument("--budget", type=int, default=500, help="rollouts in all")
    s.add_argument("--random-phase", type=int, default=200, help="rollouts before mutation begins")
    s.add_argument("--batch-size", type=int, default=1, help="rollouts that a task runs at a time")
    s.add_argument("--workers", type=int, default=1, help="batches of a generation")
    s.add_argument("--calibration", type=int, help="calibration rollouts; the preset's by default, and more with a signal")
    s.add_argument("--centroids", type=int, default=1024, help="cells of the archive")
    s.add_argument("--base-seed", type=int, default=0)
    s.add_argument("--checkpoint-every", type=int, default=100)
    s.add_argument("--output-dir", default="archive", help="folder of the runs")
    s.add_argument("--run-id", help="name of this run; its time by default")
    s.add_argument("--grid", type=int, help="side of the grid, instead of the preset's")
    s.add_argument("--steps", type=int, help="steps, instead of the preset's")
    s.add_argument("--border", choices=("wall", "torus"))
    s.add_argument("--descriptors", default=",".join(D.DEFAULT), help="three, with commas")
    s.add_argument("--descriptor-module", help="a Python file with DESCRIPTORS")
    s.add_argument("--signal-field", action="store_true")
    s.add_argument("--epsilon", type=float, default=AR.EPSILON, help="least distance to an occupied cell")
    s.add_argument("--master", help="Spark master")

    e = commands.add_parser("ecosystem", help="run the experiments of a file")
    e.add_argument("--config", required=True, help="YAML file of experiments")
    e.add_argument("--archive-dir", default="archive")
    e.add_argument("--output-dir", default="ecosystem")
    e.add_argument("--only", help="names of the experiments to run, with commas")
    e.add_argument("--master", help="Spark master")

    d = commands.add_parser("doctor", help="what this machine and session offer")
    d.add_argument("--master", help="Spark master")
    return top


def connect(args: argparse.Namespace):
    return session("tessella", **({"spark__master": args.master} if args.master else {}))


def run_search(args: argparse.Namespace) -> int:
    if args.descriptor_module:
        D.load_module(args.descriptor_module)
    changes = {k: v for k, v in (("height", args.grid), ("width", args.grid), ("steps", args.steps), ("border", args.border)) if v is not None}
    world = preset(args.preset, args.signal_field, **changes)
    calibration = args.calibration or CALIBRATION[args.preset] + SIGNAL_CALIBRATION * args.signal_field
    config = SearchConfig(budget=args.budget, random_phase=args.random_phase, batch=args.batch_size, workers=args.workers, calibration=calibration, cells=args.centroids, base_seed=args.base_seed, checkpoint_every=args.checkpoint_every, epsilon=args.epsilon, descriptors=tuple(args.descriptors.split(",")), signal=args.signal_field)
    spark = connect(args)
    run = args.run_id or time.strftime("%Y%m%d-%H%M%S")
    root, began = f"{args.output_dir.rstrip('/')}/{run}", time.time()
    T.write_document({"run_id": run, "preset": args.preset, "started": began, **asdict(world), **asdict(config)}, spark, f"{root}/manifest")

    def back(counts: dict) -> None:
        left = eta(counts, config.budget, time.time() - began)
        print(f"{counts['done']}/{config.budget} done, {counts['accepted']} accepted, {counts['occupied']} cells, best {counts['best']}, {left:.0f} s left", flush=True)

    events, best = search(spark, world, config, back=back, checkpoint=f"{root}/cells")
    log = events.select(F.lit(run).alias("run_id"), "seed", "arrival", F.array("d0", "d1", "d2").alias("d"), "quality", F.col("reason").alias("rejection_reason"), F.col("status").alias("insertion_status"), "parent", "cell")
    T.append_events(log, f"{root}/events")
    named = AR.with_creature_id(best.drop("run_id").withColumn("run_id", F.lit(run)))
    named.withColumn("has_signal", F.lit(config.signal)).write.mode("overwrite").parquet(f"{root}/archive")
    T.merge_document(spark, f"{root}/manifest", {"finished": time.time(), "occupied": best.count(), "descriptors": [asdict(D.metadata(n)) for n in config.descriptors]})
    print(f"{root}: {best.count()} cells")
    return 0


def run_ecosystem(args: argparse.Namespace) -> int:
    parsed = C.load(args.config, archive_dir=args.archive_dir)
    wanted = set(args.only.split(",")) if args.only else None
    if wanted and wanted - {e.name for e in parsed}:
        raise C.ConfigError(f"no experiments {sorted(wanted - {e.name for e in parsed})}")
    parsed = [e for e in parsed if not wanted or e.name in wanted]
    spark = connect(args)
    failed = 0
    for one in parsed:
        root = f"{args.output_dir.rstrip('/')}/{one.name}"
        try:
            runs = sorted({(s.archive_dir, s.run_id) for s in one.sources})
            archives = None
            for folder, run in runs:
                found = spark.read.parquet(AR.located(spark, f"{folder.rstrip('/')}/{run}"))
                archives = found if archives is None else archives.unionByName(found, allowMissingColumns=True)
            sources = C.require_found(C.with_sources(C.experiments(spark, [one]), archives))
            bad = C.signal_consistency(sources.withColumn("kernels", F.size("r"))).collect()
            if bad:
                raise C.ConfigError(f"sources differ in signals or kernels: {bad[0].asDict()}")
            rows = T.stage(sources.withColumns({"min_dist": F.lit(one.min_dist), "seed": F.lit(one.seed).cast("long"), "snapshot_every": F.lit(one.snapshot_every)}), "sources")
            first = rows.orderBy("species").first()
            world, signal = world_of(first.asDict(), one.grid_h, one.grid_w, one.steps, one.border), bool(first["has_signal"])
            T.stage(ecosystem_histories(rows, world, signal), "history").write.mode("overwrite").parquet(f"{root}/history")
            snaps = T.stage(ecosystems(rows, world, signal), "snapshots")
            summary(snaps, spark.read.parquet(f"{root}/history"), max(one.grid_h, one.grid_w)).write.mode("overwrite").text(f"{root}/summary")
            trajectories(rows, world, signal).write.mode("overwrite").parquet(f"{root}/trajectory")
            T.write_document(asdict(one), spark, f"{root}/config")
            print(f"{root}: done", flush=True)
        except Exception as e:  # noqa: BLE001  one experiment's failure leaves the others
            failed += 1
            print(f"{one.name}: failed: {type(e).__name__}: {e}", file=sys.stderr, flush=True)
    return 1 if failed else 0


def summary(snapshots, history, side: int):
    """One JSON document an experiment: measures of every snapshot, contact, interaction, and outcome by debounced labels."""
    species = snapshots.select("species").distinct().count()
    key = "name"
    measures = O.territory(snapshots, key, "snap").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("snap", "species", "territory", "mass"))).alias("snapshots"))
    masses = O.mass_summary(history.groupBy(key, "step").agg(F.sum("mass").alias("mass")), key)
    signal = history.groupBy(key).agg(F.max("signal_total").alias("signal_peak"))
    found = measures.join(masses, key).join(signal, key)
    if species > 1:
        pairs = O.contact(snapshots, "snap", key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b", "contact"))).alias("contacts"))
        inter = O.interaction(snapshots, "snap", key, gate=True).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b", "coefficient"))).alias("interaction"))
        found = found.join(pairs, key, "left").join(inter, key, "left")
    labels = outcome_labels(snapshots, side, species)
    windows = T.stage(O.windows(O.debounced(labels, 3, key, "species", step="snap"), key, "species", step="snap"), "windows")
    priority = O.PRIORITY if species > 1 else O.HOMO_PRIORITY
    outcome = O.final_label(windows, key, priority=priority).join(windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("species", "from_step", "to_step", "label"))).alias("windows")), key)
    return T.summary_json(found.join(outcome, key)).select(F.col("document").alias("value"))


def outcome_labels(snapshots, side: int, species: int):
    """(name, snap, species, label) of each snapshot."""
    from pyspark.sql import Window

    by = Window.partitionBy("name", "species").orderBy("snap")
    if species > 1:
        spots = O.patches(snapshots, side, "name", "snap")
        rows = O.territory(snapshots, "name", "snap").withColumn("first", F.first("territory").over(by)).join(O.ownership_entropy(snapshots, "name", "snap"), ["name", "snap"], "left").join(spots, ["name", "snap", "species"])
        return rows.select("name", "snap", "species", O.hetero_label(F.col("territory"), F.col("first"), F.coalesce("ownership_entropy", F.lit(0.0)), F.col("patch_count")).alias("label"))
    from tessella.functions.vectors import upper_median

    spots = O.patches(O.homo_mask(snapshots.drop("w"), "name"), side, "name", "snap", mask=0.0)
    rows = spots.withColumn("n0", F.first("patch_count").over(by)).withColumn("s0", F.first("patch_sizes").over(by))
    return rows.select("name", "snap", "species", O.homo_label(F.col("patch_count"), F.col("n0"), F.get("patch_sizes", F.lit(0)), upper_median(F.col("s0"))).alias("label"))


def health(spark) -> list[tuple[str, bool, str]]:
    """(what, fine, detail) of the pieces that runs need."""
    out = [("python", sys.version_info >= (3, 10), sys.version.split()[0]), ("spark", True, spark.version), ("master", True, spark.sparkContext.master)]
    for name in ("numpy", "pandas", "pyarrow", "yaml"):
        out.append((name, importlib.util.find_spec(name) is not None, "found" if importlib.util.find_spec(name) else "missing"))
    try:
        out.append(("shared folder", True, T.shared_dir(spark)))
    except ValueError as e:
        out.append(("shared folder", False, str(e)))
    try:
        out.append(("job", spark.range(10).mapInArrow(lambda it: it, "id long").count() == 10, "Arrow workers answer"))
    except Exception as e:  # noqa: BLE001  a broken worker is what is asked for
        out.append(("job", False, f"{type(e).__name__}: {e}"[:200]))
    smi = shutil.which("nvidia-smi")
    devices = subprocess.run([smi, "--list-gpus"], capture_output=True, text=True, timeout=10).stdout.strip() if smi else "none, not needed"
    out.append(("devices", True, devices))
    return out


def run_doctor(args: argparse.Namespace) -> int:
    rows = health(connect(args))
    for what, fine, detail in rows:
        print(f"{'ok  ' if fine else 'FAIL'} {what}: {detail}")
    return 0 if all(fine for _, fine, _ in rows) else 1


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"search": run_search, "ecosystem": run_ecosystem, "doctor": run_doctor}[args.command](args)
    except (ValueError, TypeError, FileNotFoundError, C.ConfigError) as e:
        print(json.dumps({"error": f"{type(e).__name__}: {e}"}), file=sys.stderr)
        return 2
