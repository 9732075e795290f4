"""Results as tables, as a JSON bundle of means, and as a page."""

from __future__ import annotations

import html
import json
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.operators.reports import heading_means


def write_scalars(scalars: DataFrame, path: str, form: str = "csv") -> None:
    """Scores are a row per source, region and name, so one file holds them."""
    writer = scalars.coalesce(1).write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)


def write_maps(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").partitionBy("source").parquet(path)


def read_scalars(df: DataFrame) -> DataFrame:
    """Scalars as they were before a CSV file: regions without a label are "None"."""
    return df.fillna("None", subset=["region"])


def bundle(scalars: DataFrame, name_of: Callable[[str], str], source_of: Callable[[str], str]) -> dict:
    """Means at three levels of headings as region, model, metric, statistic.

    What reaches the driver is a number for each of these, not data."""
    rows = heading_means(scalars).orderBy("region", "source", "heading", "name").collect()
    results: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(dict)))
    for r in rows:
        results[r["region"]][r["source"]][r["heading"]][r["name"]] = r["value"]
    regions = sorted({r["region"] for r in rows})
    whole = {"LongName": "None", "Description": "Reference data extents", "Generator": "N/A"}
    names = sorted({r["name"] for r in rows})
    return {
        "DIMENSIONS": {
            "json_structure": ["region", "model", "metric", "statistic"],
            "dimensions": {
                "region": {k: whole if k == "None" else {"LongName": name_of(k), "Description": name_of(k), "Generator": source_of(k)} for k in regions},
                "model": {m: {"Description": m, "Source": m} for m in sorted({r["source"] for r in rows}) if m != "Reference"},
                "metric": {h: {"name": h, "Abstract": "benchmark score" if "!!" in h else "composite score"} for h in sorted({r["heading"] for r in rows})},
                "statistic": {"indices": names, "short_names": names},
            },
        },
        "RESULTS": json.loads(json.dumps(results)),
    }


def page(title: str, scalars: DataFrame) -> str:
    """A block's scalars as one table."""
    columns = ["source", "region", "analysis", "name", "value"]
    rows = scalars.select(*columns).orderBy(*columns[:-1]).collect()
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    return "\n".join([f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>", cells("th", columns), *(cells("td", r) for r in rows), "</table>"])
