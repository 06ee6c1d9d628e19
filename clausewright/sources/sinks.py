"""Sinks for records and question logs, and the settings file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from clausewright.operators.index import PLAIN, Vectorizer


def write_json_lines(records: DataFrame, folder: str, order: list[str] | None = None, partitions: int | None = None) -> None:
    """One record per line in part files; ``order`` sorts across them by ranges."""
    if order:
        records = records.repartitionByRange(partitions, *order) if partitions else records.repartitionByRange(*order)
        records = records.sortWithinPartitions(*order)
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_pretty_json(records: DataFrame, path: str, most: int = 100_000) -> None:
    """One indented list in one file, for small exports; more than ``most`` records raise ValueError."""
    rows = records.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; write JSON lines instead")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def append_log(entries: DataFrame, folder: str) -> None:
    """Answered questions appended to a log of JSON lines."""
    entries.write.mode("append").json(folder)


@dataclass(frozen=True)
class Settings:
    """What a build and a search need to know."""

    paths: dict[str, str] = field(default_factory=dict)
    documents: dict[str, dict[str, str]] = field(default_factory=dict)
    top: int = 5
    vectorizer: Vectorizer = PLAIN


def read_settings(path: str) -> Settings:
    """Settings from a YAML or JSON file; relative paths start at the grandparent of the file."""
    file = Path(path).resolve()
    text = file.read_text(encoding="utf-8")
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = json.loads(text)
    base = file.parent.parent

    def full(p: str) -> str:
        return str(p if Path(p).is_absolute() else base / p)

    search = raw.get("retrieval", {})
    given = search.get("vectorizer", {})
    least, most = given.get("ngram_range", [PLAIN.least, PLAIN.most])
    how = Vectorizer(int(least), int(most), int(given.get("min_df", 1)), bool(given.get("lowercase", True)), bool(given.get("sublinear_tf", True)))
    documents = {k: {**v, **({"file": full(v["file"])} if v.get("file") else {})} for k, v in raw.get("documents", {}).items()}
    return Settings({k: full(v) for k, v in raw.get("paths", {}).items()}, documents, int(search.get("top_k", 5)), how)
