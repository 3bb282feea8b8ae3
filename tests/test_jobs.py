"""The jobs: growing input, repeated and broken runs, odd rows, and their command lines."""

import json
import logging
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import archive_feed, common, queries, text_atlas

ROOT = Path(__file__).resolve().parent.parent
CENTRES = [((i % 4) * 15.0, (i // 4) * 6.0, (i * 7) % 10 * 1.0) for i in range(16)]
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(rng, first, n):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    return [(first + i, start + dt.timedelta(minutes=rng.randrange(10**5)), rng.randrange(40), rng.choice(["view", "click", "error"]), round(rng.expovariate(1 / 30), 2), json.dumps({"k": rng.randrange(100)})) for i in range(n)]


def brute(rows):
    """Of each run and cell the best candidate and the first arrival, one row after another."""
    found = {}
    for i, ts, user, kind, value, props in {r[0]: r for r in rows}.values():
        if None in (i, user, value, ts, props) or kind == "error":
            continue
        d = (value, float(ts.hour), json.loads(props)["k"] / 10.0)
        cell = min(range(16), key=lambda c: (sum((a - b) ** 2 for a, b in zip(d, CENTRES[c])), c))
        found.setdefault((user % 10, cell), []).append((value / (value + 50.0), -i))
    return {k: (-max(v)[1], min(-i for _, i in v)) for k, v in found.items()}


def got(df):
    return {(r["run_id"], r["cell"]): (r["arrival"], r["first_arrival"]) for r in df.collect()}


def write(spark, folder, name, rows):
    """One more file of the log, as a search would leave it."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/../{name}")
    part = next(Path(f"{folder}/../{name}").glob("part-*.parquet"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(part, f"{folder}/{name}.parquet")


@pytest.fixture
def feed(spark, tmp_path):
    config = queries.settings("archive_feed") | {"files": "log*.parquet", "files_a_batch": 1}
    logs = str(tmp_path / "logs")
    os.makedirs(logs)
    return logs, lambda: archive_feed.run(spark, logs, str(tmp_path / "out"), str(tmp_path / "state"), config)


def test_feed_takes_only_what_is_new(spark, tmp_path, feed, caplog):
    rng, (logs, run) = random.Random(1), feed
    caplog.set_level(logging.INFO, "tessella.jobs")
    assert run().count() == 0  # no file yet
    first = events(rng, 0, 300)
    write(spark, logs, "log1", first)
    assert got(run()) == brute(first)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert got(run()) == brute(first)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == files  # nothing new: nothing written
    caplog.clear()
    # late arrivals of one search, some of them twice, and rows that are no candidates
    odd = [(900, None, 3, "view", 1.0, '{"k": 1}'), (901, first[0][1], None, "view", 1.0, '{"k": 1}'), (902, first[0][1], 3, "view", None, '{"k": 1}'), (903, first[0][1], 3, "view", 2.0, None), (None, first[0][1], 3, "view", 2.0, '{"k": 1}')]
    more = [(i - 1000, ts, 3, *rest) for i, ts, _, *rest in events(rng, 0, 60)]
    write(spark, logs, "log2", more + more[:20] + first[:50] + odd)
    assert got(run()) == brute(first + more)
    assert "read 135 events" in caplog.text and "read 300" not in caplog.text
    write(spark, logs, "log3", [(5000 + i, ts, 13, *rest) for i, ts, _, *rest in events(rng, 0, 40)])
    before = {p for p in (tmp_path / "out").rglob("*.parquet")}
    run()
    now = {p for p in (tmp_path / "out").rglob("*.parquet")}
    assert {p.parent.name for p in before ^ now} == {"run_id=3"}  # other searches are left alone


def test_feed_makes_a_broken_run_good(spark, tmp_path, feed):
    """The last micro-batch died between its writes: it is repeated, and its runs are made anew from what was brought."""
    rng, (logs, run) = random.Random(2), feed
    a, b = events(rng, 0, 200), events(rng, 200, 200)
    write(spark, logs, "log1", a)
    run()
    write(spark, logs, "log2", b)
    run()
    commits = tmp_path / "state/checkpoint/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    for run_id in (0, 4, 9):
        shutil.rmtree(tmp_path / f"out/run_id={run_id}")
    shutil.rmtree(tmp_path / f"state/brought/run_id=4/batch={last}")
    assert got(run()) == brute(a + b)


def test_atlas_equals_brute_force_and_reruns(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["ab", "cde", "f", "ghij", "klä"]) + rng.choice([" ", " ", "  ", "\n", "\n\n"]) for _ in range(n))
    rows = [(i, text(rng.randrange(400)), rng.choice(["en", "de/x", "7", None, ""]), "c") for i in range(300)]
    rows += [(400, None, "en", ""), (401, "", "en", ""), (None, text(50), "en", ""), (7, rows[7][1], rows[7][2], "twice"), (402, "w " * 60_000, "de/x", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, cell string").write.parquet(str(tmp_path / "docs"))
    run = lambda **more: text_atlas.run(spark, str(tmp_path / "docs"), str(tmp_path / "atlas"), queries.settings("text_atlas") | more)
    found = [tuple(r) for r in run().collect()]
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in run().collect())
    import numpy as np

    want, seen = {}, {}
    for i, t, lang, _ in rows:
        w = (t or "").split()
        if i is not None and len(w) >= 5:
            lines = [x for x in t.split("\n") if x.strip()]
            q = 0.6 * min(1.0, len(w) / 200) + 0.4 * (len(set(lines)) / len(lines))
            seen.setdefault(lang or None, []).append((q, -i, (float(len(w)), len(set(w)) / len(w), sum(map(len, w)) / len(w))))
    for lang, rs in seen.items():
        ends = [np.round(np.percentile([r[2][a] for r in rs], [5, 95]), 6) for a in range(3)]
        for q, i, d in rs:
            at = [min(max(int((v - lo) / (hi - lo) * 6 // 1), 0), 5) if hi > lo else 0 for v, (lo, hi) in zip(d, ends)]
            want.setdefault((lang, at[0] + 6 * at[1] + 36 * at[2]), []).append((q, i))
    assert {(r[7], r[0]): (r[1], r[6]) for r in found} == {k: (-max(v)[1], len(v)) for k, v in want.items()}
    assert {r[7] for r in run(least_words=10**6).collect()} == set()  # nothing of the run before is left


def test_settings_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown fields: bin;"):
        common.checked({"bin": 3}, text_atlas.DEFAULTS)
    with pytest.raises(ValueError, match="without a value: centroids"):
        common.checked({k: 1 for k in archive_feed.DEFAULTS if k != "centroids"}, archive_feed.DEFAULTS)
    (tmp_path / "c.json").write_text('{"bins": 3}')
    assert common.read_config(spark, str(tmp_path / "c.json"), text_atlas.DEFAULTS)["bins"] == 3


@pytest.mark.parametrize("job, table, extra", [("archive_feed", "", ["--state", "state"]), ("text_atlas", "/documents.parquet", [])])
def test_command_lines(tmp_path, job, table, extra):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    args = [sys.executable, "-m", f"jobs.{job}", "--input", data + table, "--output", str(tmp_path / "out"), "--config", str(ROOT / f"jobs/{job}.json")]
    args += [str(tmp_path / a) if a == "state" else a for a in extra]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "tessella.jobs read " in done.stderr and list((tmp_path / "out").rglob("*.parquet"))
