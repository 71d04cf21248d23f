"""Readable reports of results that are a few rows, and logging set up for long runs."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import align, quality


def alignment_text(tables: Mapping[str, DataFrame], key: str) -> str:
    """Matched samples per modality and overlaps per pair."""
    lines = ["Sample alignment"]
    for r in align.alignment_stats(tables, key).orderBy("modality").collect():
        lines.append(f"  {r['modality']}: {r['n_matched']} of {r['n_samples']} samples matched ({r['matched_percent']:.1f} %)")
    for r in align.overlap(tables, key).filter("a < b").orderBy("a", "b").collect():
        lines.append(f"  {r['a']} and {r['b']}: {r['n_common']} common samples (Jaccard {r['jaccard']:.3f})")
    return "\n".join(lines)


def data_text(df: DataFrame, name: str = "data") -> str:
    """Shape, types and missing values of a table."""
    shares = {r["column_name"]: r["missing_percent"] for r in quality.missing_report(df, df.columns).collect()}
    lines = [f"{name}: {df.count()} rows, {len(df.columns)} columns"]
    lines += [f"  {f.name} ({f.dataType.simpleString()}): {shares.get(f.name, 0.0):.1f} % missing" for f in df.schema.fields]
    return "\n".join(lines)


def integration_summary(results: Mapping[str, object]) -> list[dict[str, object]]:
    """One row per method: whether it worked, and how large its result is."""
    rows = []
    for method, result in results.items():
        if isinstance(result, DataFrame):
            rows.append({"method": method, "status": "success", "n_samples": result.count(), "n_features": len(result.columns) - 1})
        elif isinstance(result, dict) and "integrated" in result:
            rows.append({"method": method, "status": "success", "n_samples": result["integrated"].count(), "n_features": sum(len(t.columns) - 1 for n, t in result.items() if n != "integrated")})
        else:
            rows.append({"method": method, "status": "failed", "n_samples": 0, "n_features": 0})
    return rows


def bands(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``df`` with ``band``: poor below ``low``, good from ``high``, else fair."""
    return df.withColumn("band", F.when(F.col(column) < low, "poor").when(F.col(column) < high, "fair").otherwise("good"))


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def set_up_logging(path: str | None = None, level: int = logging.INFO, as_json: bool = False) -> logging.Logger:
    """Log to the console, or to files of 10 MB of which five are kept."""
    handler = RotatingFileHandler(path, maxBytes=10_000_000, backupCount=5, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log = logging.getLogger("helixmill")
    log.handlers[:] = [handler]
    log.setLevel(level)
    return log
