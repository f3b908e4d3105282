"""Configurations, bundles and frozen copies of small files (SRC20, SNK10, SNK11, SCL15, SCL53): work of the driver."""

from __future__ import annotations

import copy
import hashlib
import json
import shutil
import textwrap
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of the files that go into a bundle.
SUFFIXES = (".json", ".jsonl", ".yaml", ".md", ".log")


def configured(*layers: dict, overrides: list[str] = ()) -> dict:
    """SRC20: the layers merged, later ones over earlier ones and mappings key by key; then overrides such as ``a.b=3``, whose values are JSON or else text."""
    out: dict = {}

    def merge(into: dict, layer: dict) -> None:
        for key, value in layer.items():
            if isinstance(value, dict) and isinstance(into.get(key), dict):
                merge(into[key], value)
            else:
                into[key] = copy.deepcopy(value)

    for layer in layers:
        merge(out, layer)
    for text in overrides:
        path, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"no value in {text!r}")
        try:
            parsed = json.loads(value)
        except ValueError:
            parsed = value
        for key in reversed(path.split(".")):
            parsed = {key: parsed}
        merge(out, parsed)
    return out


def bundle(folder: str, archive: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """SNK10: the folder's files with one of the suffixes as a zip file; their names in it, sorted."""
    root = Path(folder)
    names = sorted(p.relative_to(root.parent).as_posix() for p in root.rglob("*") if p.is_file() and p.suffix in suffixes)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            z.write(root.parent / name, name)
    return names


def frozen(source: str, recorded: dict[str, str], target: str) -> dict[str, str]:
    """SNK11: copy the files of ``recorded`` (name to sha256) to a new folder once all have their digests; the digests of the copies."""
    digest = lambda p: hashlib.sha256(p.read_bytes()).hexdigest()
    if wrong := sorted(n for n, want in recorded.items() if not (Path(source) / n).is_file() or digest(Path(source) / n) != want):
        raise ValueError(f"other than recorded: {', '.join(wrong)}")
    Path(target).mkdir(parents=True)
    for name in recorded:
        (Path(target) / name).parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(Path(source) / name, Path(target) / name)
    return {n: digest(Path(target) / n) for n in recorded}


@F.pandas_udf(T.StringType())
def clipped(text: pd.Series) -> pd.Series:
    """SCL15: two lines of at most 72 characters, an ellipsis for the last one where more follows; NULL for NULL."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        lines = textwrap.wrap(value.replace("\n", " "), 72)
        return "\n".join(lines if len(lines) <= 2 else [lines[0], lines[1][:-1] + "…"])

    return text.map(one)


def now() -> Column:
    """SCL53: the time of the query in UTC as text; the session's zone doesn't matter."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
