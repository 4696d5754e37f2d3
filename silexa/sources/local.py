"""Small files on the driver: lines, separated values, maps and objects. Tables belong into the readers."""
from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any


def read_lines(path: str | Path) -> list[str]:
    return Path(path).read_text(encoding="utf-8").splitlines()


def write_lines(path: str | Path, lines: Iterable[Any]) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


def read_separated(path: str | Path, separator: str = ",", header: bool = False) -> list[list[str]]:
    """Rows of fields; quotes are understood for commas."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f, delimiter=separator))
    return rows[1:] if header else rows


def write_separated(path: str | Path, rows: Iterable[Iterable[Any]], separator: str = ",") -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    with open(at, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, delimiter=separator, lineterminator="\n").writerows(rows)


def read_map(path: str | Path, separator: str = "\t") -> dict[str, str]:
    """key -> value of two-field lines; others are skipped, of repeated keys the last counts."""
    return dict(x.split(separator, 1) for x in read_lines(path) if separator in x)


def write_map(path: str | Path, m: dict, separator: str = "\t") -> None:
    write_lines(path, (f"{k}{separator}{v}" for k, v in m.items()))


def read_map_of_maps(path: str | Path, separator: str = "\t") -> dict[str, dict[str, str]]:
    """outer -> inner -> value of three-field lines."""
    out: dict[str, dict[str, str]] = {}
    for x in read_lines(path):
        f = x.split(separator, 2)
        if len(f) == 3:
            out.setdefault(f[0], {})[f[1]] = f[2]
    return out


def write_map_of_maps(path: str | Path, m: dict[Any, dict], separator: str = "\t") -> None:
    write_lines(path, (f"{a}{separator}{b}{separator}{v}" for a, inner in m.items() for b, v in inner.items()))


def invert_map_of_maps(m: dict[Any, dict]) -> dict[Any, dict]:
    out: dict[Any, dict] = {}
    for a, inner in m.items():
        for b, v in inner.items():
            out.setdefault(b, {})[a] = v
    return out


def read_object(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_object(path: str | Path, x: Any) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(x, ensure_ascii=False), encoding="utf-8")
