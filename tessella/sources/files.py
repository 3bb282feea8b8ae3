"""Files written by executors, through pyarrow's file systems."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs


def write_partition(rows: Iterable, root: str) -> None:
    """Write each (path, content); a file appears under its name only when it is whole."""
    system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    for row in rows:
        target = f"{base}/{row['path']}"
        system.create_dir(target.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{target}.part") as out:
            out.write(bytes(row["content"]))
        system.move(f"{target}.part", target)
