"""One self-contained page of a run's results: cards, vector charts and tables from bounded aggregates."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a line, bars of a chart and rows of a table at most; longer series are averaged in as many steps.
POINTS, BARS, ROWS = 240, 20, 12
WIDTH, HEIGHT, EDGE = 720, 240, 40

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>
body {{ font: 15px sans-serif; margin: 2em auto; max-width: 780px; color: #222 }}
.cards {{ display: flex; flex-wrap: wrap; gap: 1em }} .card {{ border: 1px solid #ccc; border-radius: 6px; padding: .6em 1em }}
.card b {{ display: block; font-size: 1.5em }} svg {{ width: 100%; height: auto }} td, th {{ padding: .2em .8em; text-align: left; border-bottom: 1px solid #ddd }}
</style></head><body><h1>{title}</h1>
{body}
</body></html>
"""


def cards(values: dict[str, object]) -> str:
    """A row of named values; numbers to three places."""
    shown = ((k, f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else "-" if v is None else str(v)) for k, v in values.items())
    return '<div class="cards">' + "".join(f'<div class="card">{escape(k.replace("_", " "))}<b>{escape(v)}</b></div>' for k, v in shown) + "</div>"


def series(df: DataFrame, x: str, y: str, by: str, points: int = POINTS) -> dict[str, list[tuple[float, float]]]:
    """Means of y in points steps of x for each of the BARS most frequent values of by, from one aggregation."""
    span = df.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b")).first()
    if span["a"] is None:
        return {}
    step = (span["b"] - span["a"]) / (points - 1) or 1.0
    most = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(BARS).select(by)
    place = F.round((F.col(x) - span["a"]) / step).cast("int")
    rows = df.join(F.broadcast(most), by).groupBy(F.col(by).cast("string").alias("k"), place.alias("p")).agg(F.avg(y).alias("v")).orderBy("k", "p").collect()  # BARS * points
    out: dict[str, list[tuple[float, float]]] = {}
    for r in rows:
        if r["v"] is not None:
            out.setdefault(str(r["k"]), []).append((span["a"] + r["p"] * step, float(r["v"])))
    return out


def line_chart(title: str, lines: dict[str, list[tuple[float, float]]]) -> str:
    """Lines over common axes from 0, each with its name; an empty frame without points."""
    points = [p for line in lines.values() for p in line]
    low, high = (min(p[0] for p in points), max(p[0] for p in points)) if points else (0.0, 1.0)
    top = max((p[1] for p in points), default=0.0) or 1.0

    def at(p: tuple[float, float]) -> str:
        return f"{EDGE + (p[0] - low) / ((high - low) or 1) * (WIDTH - 2 * EDGE):.1f},{HEIGHT - EDGE - p[1] / top * (HEIGHT - 2 * EDGE):.1f}"

    drawn = "".join(f'<polyline fill="none" stroke="hsl({47 * k % 360},60%,45%)" stroke-width="1.5" points="{" ".join(map(at, line))}"><title>{escape(name)}</title></polyline><text x="{WIDTH - EDGE + 4}" y="{EDGE + 12 * k}" font-size="10" fill="hsl({47 * k % 360},60%,35%)">{escape(name)}</text>' for k, (name, line) in enumerate(lines.items()))
    axes = f'<path d="M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}" fill="none" stroke="#888"/><text x="2" y="{EDGE}" font-size="10">{top:.4g}</text><text x="{EDGE}" y="{HEIGHT - EDGE + 14}" font-size="10">{low:.4g}</text><text x="{WIDTH - EDGE}" y="{HEIGHT - EDGE + 14}" font-size="10" text-anchor="end">{high:.4g}</text>'
    return f'<h2>{escape(title)}</h2><svg viewBox="0 0 {WIDTH} {HEIGHT}" role="img">{axes}{drawn}</svg>'


def bar_chart(title: str, values: dict[str, float]) -> str:
    """Horizontal bars with their names and values, the largest first."""
    ordered = sorted(values.items(), key=lambda v: (-v[1], v[0]))[:BARS]
    top = max((v for _, v in ordered), default=0) or 1
    rows = "".join(f'<text x="150" y="{18 + 22 * k}" font-size="12" text-anchor="end">{escape(name)}</text><rect x="156" y="{6 + 22 * k}" width="{(WIDTH - 240) * v / top:.1f}" height="16" fill="#4a7ab5"/><text x="{160 + (WIDTH - 240) * v / top:.1f}" y="{18 + 22 * k}" font-size="12">{v:g}</text>' for k, (name, v) in enumerate(ordered))
    return f'<h2>{escape(title)}</h2><svg viewBox="0 0 {WIDTH} {max(1, len(ordered)) * 22 + 8}" role="img">{rows}</svg>'


def table(title: str, df: DataFrame, order: str, columns: list[str]) -> str:
    """The ROWS rows of the largest order, ties to the smaller first column."""
    have = [c for c in columns if c in df.columns]
    rows = df.orderBy(F.desc_nulls_last(order), have[0]).limit(ROWS).select(*have).collect()
    cells = "".join("<tr>" + "".join(f"<td>{escape('-' if v is None else f'{v:.2f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in have)}</tr>{cells}</table>"


def level1_page(tables: dict[str, DataFrame], summary: dict[str, object]) -> str:
    """Quality, objects over time, classes and the longest objects of a level 1 run."""
    quality, classes = summary["tracking_quality_proxies"], summary["unique_tracks_by_class"]
    parts = [
        cards(quality),  # type: ignore[arg-type]
        line_chart("Visible objects over time (s)", series(tables["timeseries_counts"], "second", "visible_objects", "class_name")),
        bar_chart("Tracks by class", classes),  # type: ignore[arg-type]
        table("Longest objects", tables["object_metrics"], "duration_s", ["segment_id", "class_name", "duration_s", "path_length_px", "mean_speed_px_s", "p95_speed_px_s"]),
    ]
    return _PAGE.format(title="Tracking", body="\n".join(parts))


def level2_page(tables: dict[str, DataFrame], summary: dict[str, object]) -> str:
    """Metric summary, distributions, speeds of the longest segments and the longest objects of a level 2 run."""
    parts = [cards({"unique tracks": summary["unique_tracks"], "segments": summary["segments"], **summary["metric"]})]  # type: ignore[dict-item]
    parts += [bar_chart(f"Tracks by {kind}", found) for kind, found in sorted(summary["distributions"].items())]  # type: ignore[attr-defined]
    parts.append(line_chart("Speed of the longest segments over time (s)", series(tables["speed_profiles"], "timestamp_s", "speed", "segment_id")))
    parts.append(table("Longest objects", tables["level2_object_insights"], "duration_s", ["segment_id", "class_name", "dominant_color", "relative_size_class", "duration_s", "mean_speed_px_s", "mean_speed_kmh"]))
    return _PAGE.format(title="Object insights", body="\n".join(parts))
