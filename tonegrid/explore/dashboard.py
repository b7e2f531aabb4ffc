"""A single-page dashboard (SNK8-10, VIZ6-11): bounded tables, one JSON payload, one HTML file."""

from __future__ import annotations

import base64
import html
import json
import math
import shutil
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import KEY
from ..operators.summaries import extra_columns, is_vector_column, ranges, select_patterns, top_variance
from ..plans.registry import detect
from .projection import choose_method, dimensions, mds, pca

MAX_ROWS = 2000
INDEX = (KEY, "k", "time", "onset", "offset", "segment_idx", "text")


def json_value(v):
    """SCL14."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else None
    return str(v)


def _columns(rows: list, names: list[str]) -> dict:
    return {n: [json_value(r[n]) for r in rows] for n in names}


def hop_of(times: list[float], meta: dict | None) -> float:
    """AGG16: the sidecar's hop, else the median positive step, else 0.5."""
    if meta and meta.get("frames", {}).get("hop_sec"):
        return float(meta["frames"]["hop_sec"])
    steps = sorted(b - a for a, b in zip(times, times[1:], strict=False) if b > a)
    if not steps:
        return 0.5
    m = len(steps) // 2
    return steps[m] if len(steps) % 2 else (steps[m - 1] + steps[m]) / 2


def _points(df: DataFrame, columns: list[str], k: int, method: str) -> dict:
    """Projected points of complete rows in time order, with their times."""
    times = [c for c in ("time", "onset") if c in df.columns]
    if method == "mds":
        rows = df.orderBy(*times).select(*columns, *times).toPandas()
        points, explained, at = mds(rows[columns].to_numpy(dtype=float), k)[0].tolist(), [], (rows[times[0]].tolist() if times else [])
    else:
        found, explained = pca(df, columns, k)
        rows = found.orderBy(*times).select("projection", *times).collect()
        points, at = [r.projection for r in rows], [r[times[0]] for r in rows] if times else []
    return {"method": method, "explained": [json_value(v) for v in explained], "points": [[json_value(float(v)) for v in p] for p in points], "times": [json_value(t) for t in at]}


#: VIZ8: how the values of the chosen row are drawn beside a model.
DETAILS = {"bars_norm": "scaled to each column's range", "bars_sorted": "largest first", "bars_prob": "as shares of one"}


def model_entry(df: DataFrame, model, n_rows: int) -> dict:
    """VIZ6-8: scalar columns, ranges, the most variable ones, the detail panel, a projection, and a trajectory (always by PCA)."""
    columns = select_patterns(df.columns, [*model.columns, f"{model.name}_[0-9]*"])
    scalars = [c for c in columns if not is_vector_column(c) or model.kind != "embedding"]
    entry = {"name": model.name, "description": model.description, "detail": model.detail, "detail_label": DETAILS.get(model.detail), "columns": scalars}
    if scalars:
        entry["ranges"] = {r["column"]: [json_value(r.low), json_value(r.high)] for r in ranges(df, scalars).collect()}
        entry["top"] = [r["column"] for r in top_variance(df, scalars, model.top).collect()]
    complete = df.dropna(subset=columns)
    if len(columns) >= 2 and complete.count() >= 3:
        k = dimensions(n_rows, len(columns))
        entry["projection"] = _points(complete, columns, k, choose_method(n_rows, len(columns)))
        entry["trajectory"] = entry["projection"] if entry["projection"]["method"] == "pca" else _points(complete, columns, k, choose_method(n_rows, len(columns), trajectory=True))
    return entry


def payload(frames: DataFrame | None = None, transcript: DataFrame | None = None, meta: dict | None = None, max_rows: int = MAX_ROWS) -> dict:
    """VIZ9, LIM1: everything the page shows; the first ``max_rows`` rows of each table (a display limit, sizes are reported)."""
    if frames is None and transcript is None:
        raise ValueError("nothing to show: no frames and no transcript")
    out: dict = {"models": [], "tables": {}}
    for name, df, level in (("frames", frames, "frame"), ("transcript", transcript, "segment")):
        if df is None:
            continue
        n = df.count()
        order = [c for c in ("time", "onset") if c in df.columns]
        shown = (df.orderBy(*order) if order else df).limit(max_rows).persist()
        models = detect(df.columns, level)
        features = [c for m in models for c in select_patterns(df.columns, [*m.columns, f"{m.name}_[0-9]*"])]
        names = [c for c in df.columns if c in INDEX] + [c for c in dict.fromkeys(features) if not is_vector_column(c)] + extra_columns(df.columns, list(INDEX), features)
        rows = shown.select(*dict.fromkeys(names)).collect()
        out["tables"][name] = {"rows": n, "shown": len(rows), "data": _columns(rows, list(dict.fromkeys(names)))}
        if name == "frames":
            out["hop"] = hop_of([r["time"] for r in rows if r["time"] is not None], meta)
        out["models"] += [model_entry(shown, m, len(rows)) for m in models]
        shown.unpersist()
    if not out["models"]:
        raise ValueError("no known model in these tables")
    return out


def audio_uri(content: bytes, kind: str = "audio/wav") -> str:
    """SNK9: an embedded player source; mono MP3 where ``ffmpeg`` is there and makes it smaller."""
    if kind == "audio/wav" and shutil.which("ffmpeg"):
        done = subprocess.run(["ffmpeg", "-v", "error", "-i", "pipe:0", "-ac", "1", "-b:a", "96k", "-f", "mp3", "pipe:1"], input=content, capture_output=True)
        if not done.returncode and 0 < len(done.stdout) < len(content):
            content, kind = done.stdout, "audio/mpeg"
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


def play_span(t=None, hop: float = 0.5, onset=None, offset=None) -> tuple[float, float]:
    """PRJ6."""
    return (max(0.0, t - hop / 2), t + hop / 2) if t is not None else (onset, offset)


def render(data: dict, title: str, audio: str | None = None) -> str:
    """SNK8: the page; payload and title are escaped for their places."""
    body = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")
    player = f'<audio id="player" controls src="{html.escape(audio, quote=True)}"></audio>' if audio else ""
    return _PAGE.replace("@TITLE@", html.escape(title)).replace("@PLAYER@", player).replace("@DATA@", body)


def create_dashboard(path: str, title: str, frames: DataFrame | None = None, transcript: DataFrame | None = None, meta: dict | None = None, audio: bytes | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(payload(frames, transcript, meta), title, audio_uri(audio) if audio else None))


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title>
<style>body{font:14px system-ui;margin:1.5em;max-width:70em}svg{border:1px solid #ccc;width:100%;height:140px}h2{margin:1em 0 .2em}.name{color:#555}
.bar{display:flex;gap:.5em}.bar i{background:#59a;height:1em}.bar span{width:14em;overflow:hidden}label{margin-right:1em}</style></head>
<body><h1>@TITLE@</h1>@PLAYER@<p><label><input type="checkbox" id="smooth"> smooth</label><span id="now"></span> (arrow keys move, space plays)</p><div id="view"></div>
<script type="application/json" id="data">@DATA@</script>
<script>
const data = JSON.parse(document.getElementById('data').textContent), view = document.getElementById('view'), player = document.getElementById('player');
const smooth = document.getElementById('smooth'), now = document.getElementById('now'), ns = 'http://www.w3.org/2000/svg';
const add = (tag, text, to) => { const e = document.createElement(tag); e.textContent = text; (to || view).append(e); return e; };
const shape = (tag, attributes, to) => { const e = document.createElementNS(ns, tag); for (const k in attributes) e.setAttribute(k, attributes[k]); to.append(e); return e; };
const first = Object.values(data.tables)[0], times = first.data.time || first.data.onset || [];
let row = 0;
const rolling = v => { const half = Math.floor(Math.min(10, Math.max(2, Math.floor(v.length / 3))) / 2);
  return v.map((_, i) => { const w = v.slice(Math.max(0, i - half), i + half + 1).filter(x => x !== null); return w.length ? w.reduce((a, b) => a + b) / w.length : null; }); };
const frame = points => { const ok = points.filter(p => p[0] !== null && p[1] !== null), range = k => [Math.min(...ok.map(p => p[k])), Math.max(...ok.map(p => p[k]))];
  const [x0, x1] = range(0), [y0, y1] = range(1); return { ok, at: p => [10 + 980 * (p[0] - x0) / ((x1 - x0) || 1), 130 - 120 * (p[1] - y0) / ((y1 - y0) || 1)] }; };
const canvas = () => { const s = document.createElementNS(ns, 'svg'); s.setAttribute('viewBox', '0 0 1000 140'); s.setAttribute('preserveAspectRatio', 'none'); return s; };
const line = values => { const s = canvas(), { ok, at } = frame((smooth.checked ? rolling(values) : values).map((y, i) => [i, y]));
  if (ok.length) shape('polyline', { points: ok.map(p => at(p).join(',')).join(' '), fill: 'none', stroke: '#246' }, s);
  const x = 10 + 980 * row / Math.max(1, values.length - 1); shape('line', { x1: x, x2: x, y1: 0, y2: 140, stroke: '#c33' }, s);
  s.onclick = e => go(Math.round(e.offsetX / s.clientWidth * (values.length - 1)), true); return s; };
const scatter = (points, path) => { const s = canvas(), { ok, at } = frame(points);
  if (path) shape('polyline', { points: ok.map(p => at(p).join(',')).join(' '), fill: 'none', stroke: '#aaa' }, s);
  for (const p of ok) { const [x, y] = at(p); shape('circle', { cx: x, cy: y, r: 3, fill: '#246' }, s); }
  return s; };
const bars = (m, table) => { const box = document.createElement('div'); let cells = m.columns.map(c => [c, table.data[c][row]]);
  if (m.detail === 'bars_sorted') cells.sort((a, b) => (b[1] === null ? -1 : b[1]) - (a[1] === null ? -1 : a[1]));
  for (const [c, v] of cells) { const [lo, hi] = (m.ranges || {})[c] || [0, 1], part = v === null ? 0 : m.detail === 'bars_norm' ? (hi > lo ? (v - lo) / (hi - lo) : 0) : Math.abs(v);
    const b = add('div', '', box); b.className = 'bar'; add('span', c, b); add('i', '', b).style.width = 20 * Math.min(1, Math.max(0, part)) + 'em'; add('span', v === null ? '' : v, b); }
  return box; };
const choices = {};
const choose = (m, key, columns, start) => { const s = document.createElement('select'); for (const c of columns) { const o = add('option', c, s); o.value = c; } s.value = choices[m.name + key] || start;
  s.onchange = () => { choices[m.name + key] = s.value; show(); }; return s; };
function show() {
  view.replaceChildren();
  now.textContent = times.length ? 'at ' + times[row] + ' s ' : '';
  for (const m of data.models) {
    add('h2', m.name); add('div', m.description);
    const table = Object.values(data.tables).find(t => m.columns.some(c => c in t.data));
    if (table) {
      for (const c of m.top || []) { add('div', c).className = 'name'; view.append(line(table.data[c])); }
      if (m.detail) { add('div', m.detail_label).className = 'name'; view.append(bars(m, table)); }
      if (m.columns.length > 1) { const x = choose(m, 'x', m.columns, m.columns[0]), y = choose(m, 'y', m.columns, m.columns[1]); view.append(x, y);
        view.append(scatter(table.data[x.value].map((v, i) => [v, table.data[y.value][i]]))); }
    }
    if (m.projection) { add('div', 'projection: ' + m.projection.method).className = 'name'; view.append(scatter(m.projection.points)); }
    if (m.trajectory) { add('div', 'trajectory').className = 'name'; view.append(scatter(m.trajectory.points, true)); }
  }
}
function go(to, play) {
  row = Math.min(Math.max(0, to), Math.max(0, first.shown - 1));
  if (player && data.hop && times.length && play) { player.currentTime = Math.max(0, times[row] - data.hop / 2); player.play(); }
  show();
}
document.onkeydown = e => { if (e.target.tagName === 'SELECT') return;
  if (e.key === 'ArrowRight') go(row + 1); else if (e.key === 'ArrowLeft') go(row - 1); else if (e.key === ' ' && player) { e.preventDefault(); player.paused ? player.play() : player.pause(); } };
if (player) player.ontimeupdate = () => { const i = times.reduce((b, t, k) => Math.abs(t - player.currentTime) < Math.abs(times[b] - player.currentTime) ? k : b, 0); if (i !== row) { row = i; show(); } };
smooth.onchange = show;
show();
</script></body></html>
"""
