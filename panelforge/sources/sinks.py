"""Writers: tables stay distributed; reports take bounded, collected rows only."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import feature_json

#: Rows that a report, record or chart takes at most.
REPORT_ROWS = 5_000


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV part files with a header, ordered within and across parts if asked."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).csv(path)


def write_parts(df: DataFrame, path: str, part: str = "split", mode: str = "overwrite") -> None:
    """One folder for each value of a column."""
    df.write.mode(mode).partitionBy(part).parquet(path)


def with_errors(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    e = F.col(guess) - F.col(truth)
    return df.withColumns({"error": e, "abs_error": F.abs(e)})


def write_predictions(df: DataFrame, path: str, truth: str = "y_true", guess: str = "y_pred") -> None:
    write_csv(with_errors(df, truth, guess), path)


def bounded_rows(df: DataFrame, most: int = REPORT_ROWS) -> list[dict]:
    """Rows on the driver; more than `most` are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    return [r.asDict(recursive=True) for r in rows]


def _write(path: str, text: str) -> None:
    """One small file through Hadoop's file system, so that remote paths work."""
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_text(text: str, path: str) -> None:
    """A small text, such as a chart, as one file."""
    _write(path, text)


def write_record(record, path: str) -> None:
    """A JSON document: a dict, or the rows of a small frame."""
    value = bounded_rows(record) if isinstance(record, DataFrame) else record
    _write(path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def write_list(spark, lines: Sequence[str], path: str) -> None:
    """A short list, one entry a line in order, written by Spark, so that remote paths work."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def feature_lines(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature a line, for outputs of any size."""
    return df.select(feature_json(F.col(lon), F.col(lat), properties).alias("value"))


def write_geojson(df: DataFrame, lon: str, lat: str, properties: list[str], path: str, most: int = 100_000) -> None:
    """A FeatureCollection file of at most `most` points."""
    features = [r["value"] for r in bounded_rows(feature_lines(df, lon, lat, properties), most)]
    _write(path, '{"type":"FeatureCollection","features":[' + ",".join(features) + "]}")


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    rows = bounded_rows(df)
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(show(r[c]) for c in df.columns) + " |\n" for r in rows)


def write_report(title: str, sections: dict[str, DataFrame | str], path: str) -> None:
    """A Markdown report of texts and small tables."""
    body = "".join(f"\n## {k}\n\n{v if isinstance(v, str) else markdown_table(v)}\n" for k, v in sections.items())
    _write(path, f"# {title}\n{body}")


def _scaled(values: list[float | None], low: float, high: float) -> list[float | None]:
    known = [v for v in values if v is not None]
    if not known:
        return values
    a, b = min(known), max(known)
    return [None if v is None else low + (v - a) / ((b - a) or 1) * (high - low) for v in values]


def line_chart(df: DataFrame, label: str, value: str, title: str, width: int = 900, height: int = 320, labels: int = 12) -> str:
    """An SVG line over the rows' order; nulls break the line, labels are thinned, and the axis shows the least and greatest value."""
    rows = bounded_rows(df.select(label, value))
    xs = _scaled([float(i) for i in range(len(rows))], 50.0, width - 20.0)
    ys = _scaled([None if r[value] is None else float(r[value]) for r in rows], height - 50.0, 40.0)
    runs: list[list[str]] = [[]]
    for x, y in zip(xs, ys, strict=True):
        if y is None:
            runs.append([])
        else:
            runs[-1].append(f"{x:.1f},{y:.1f}")
    lines = "".join(f'<polyline fill="none" stroke="#1f6f8b" stroke-width="2" points="{" ".join(r)}"/>' for r in runs if r)
    step = max(1, -(-len(rows) // labels))
    ticks = "".join(f'<text x="{xs[i]:.1f}" y="{height - 20}" font-size="11" text-anchor="middle">{html.escape(str(rows[i][label]))}</text>' for i in range(0, len(rows), step))
    known = [float(r[value]) for r in rows if r[value] is not None]
    ends = [(min(known), height - 50), (max(known), 40)] if known else []
    axis = "".join(f'<text x="45" y="{y + 4}" font-size="11" text-anchor="end">{_short(v)}</text><line x1="50" x2="{width - 20}" y1="{y}" y2="{y}" stroke="#dddddd"/>' for v, y in ends)
    return _svg(title, width, height, axis + lines + ticks)


def _short(v: float) -> str:
    return str(int(v)) if v == int(v) else f"{v:.4g}"


def bar_chart(df: DataFrame, label: str, value: str, title: str, width: int = 900, row: int = 24) -> str:
    """An SVG of horizontal bars in row order."""
    rows = bounded_rows(df.select(label, value))
    most = max([abs(float(r[value])) for r in rows if r[value] is not None] or [1.0]) or 1.0
    bars = "".join(
        f'<text x="195" y="{54 + i * row}" font-size="12" text-anchor="end">{html.escape(str(r[label]))}</text><rect x="200" y="{42 + i * row}" height="{row - 8}" width="{abs(float(r[value] or 0)) / most * (width - 240):.1f}" fill="#1f6f8b"/>'
        for i, r in enumerate(rows)
    )
    return _svg(title, width, 60 + row * len(rows), bars)


def _svg(title: str, width: int, height: int, body: str) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{width // 2}" y="24" font-size="16" text-anchor="middle">{html.escape(title)}</text>'
    return f"{head}{body}</svg>"

