"""Labelling by hand: a page to draw boxes on images in the browser, and what it exports as tables."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The page is one file without outside parts: images are opened from the disk and never leave the browser.
PAGE = """<!doctype html>
<meta charset="utf-8"><title>Label boxes</title>
<style>
body { font: 14px sans-serif; margin: 0; display: grid; grid-template-columns: 14em 1fr; height: 100vh }
aside { padding: 1em; background: #eee; overflow: auto }
main { padding: 1em; overflow: auto }
canvas { border: 1px solid #999; cursor: crosshair }
li { cursor: pointer; list-style: none } li.on { font-weight: bold }
</style>
<aside>
  <form id="adder"><input id="label" placeholder="new label" size="12"> <button>add</button></form>
  <ul id="labels"></ul>
  <p><input type="file" id="files" accept="image/*" multiple></p>
  <p><button id="back">back</button> <button id="next">next</button> <span id="where"></span></p>
  <p><button id="undo">undo box</button> <button id="clear">clear image</button></p>
  <p>zoom <input type="range" id="zoom" min="0.25" max="4" step="0.25" value="1"></p>
  <p><button id="one">labels of this image</button></p>
  <p><button id="all">labels of all images</button></p>
  <p><button id="stop">stop the server</button></p>
</aside>
<main><canvas id="sheet"></canvas></main>
<script>
const $ = id => document.getElementById(id), pen = $("sheet").getContext("2d");
const state = { labels: [], label: 0, images: [], at: 0, drag: null };
const hue = k => `hsl(${k * 137.5 % 360} 80% 45%)`;
const now = () => state.images[state.at];

function listLabels() {
  $("labels").replaceChildren(...state.labels.map((name, k) => {
    const item = document.createElement("li");
    item.textContent = name; item.style.color = hue(k); item.className = k === state.label ? "on" : "";
    item.onclick = () => { state.label = k; listLabels(); };
    return item;
  }));
}
function paint() {
  const image = now(), zoom = +$("zoom").value;
  $("where").textContent = image ? `${state.at + 1} / ${state.images.length}: ${image.name}` : "";
  if (!image) return;
  $("sheet").width = image.bitmap.width * zoom; $("sheet").height = image.bitmap.height * zoom;
  pen.drawImage(image.bitmap, 0, 0, $("sheet").width, $("sheet").height);
  for (const b of [...image.boxes, ...(state.drag ? [state.drag] : [])]) {
    pen.strokeStyle = hue(b.cls); pen.lineWidth = 2;
    pen.strokeRect(b.x1 * zoom, b.y1 * zoom, (b.x2 - b.x1) * zoom, (b.y2 - b.y1) * zoom);
  }
}
const place = e => [e.offsetX / +$("zoom").value, e.offsetY / +$("zoom").value];
$("sheet").onmousedown = e => { const [x, y] = place(e); if (now() && state.labels.length) state.drag = { cls: state.label, x1: x, y1: y, x2: x, y2: y }; };
$("sheet").onmousemove = e => { if (state.drag) { [state.drag.x2, state.drag.y2] = place(e); paint(); } };
onmouseup = () => {
  const b = state.drag; state.drag = null;
  if (b && Math.abs(b.x2 - b.x1) > 2 && Math.abs(b.y2 - b.y1) > 2)
    now().boxes.push({ cls: b.cls, x1: Math.min(b.x1, b.x2), y1: Math.min(b.y1, b.y2), x2: Math.max(b.x1, b.x2), y2: Math.max(b.y1, b.y2) });
  paint();
};
const row = i => ({ image_path: i.name, width: i.bitmap.width, height: i.bitmap.height, names: state.labels, boxes: i.boxes });
function yolo(i) {
  const w = i.bitmap.width, h = i.bitmap.height;
  return i.boxes.map(b => [b.cls, ...[(b.x1 + b.x2) / 2 / w, (b.y1 + b.y2) / 2 / h, (b.x2 - b.x1) / w, (b.y2 - b.y1) / h].map(v => v.toFixed(6))].join(" ")).join("\\n") + "\\n";
}
function save(name, text) { const a = document.createElement("a"); a.href = URL.createObjectURL(new Blob([text])); a.download = name; a.click(); }
$("adder").onsubmit = e => { e.preventDefault(); const name = $("label").value.trim(); if (name && !state.labels.includes(name)) state.labels.push(name); $("label").value = ""; listLabels(); };
$("files").onchange = async e => { for (const f of e.target.files) state.images.push({ name: f.name, bitmap: await createImageBitmap(f), boxes: [] }); paint(); };
$("back").onclick = () => { state.at = Math.max(0, state.at - 1); paint(); };
$("next").onclick = () => { state.at = Math.max(0, Math.min(state.images.length - 1, state.at + 1)); paint(); };
$("undo").onclick = () => { now()?.boxes.pop(); paint(); };
$("clear").onclick = () => { if (now()) now().boxes = []; paint(); };
$("zoom").oninput = paint;
$("one").onclick = () => now() && save(now().name.replace(/\\.[^.]+$/, "") + ".txt", yolo(now()));
$("all").onclick = () => save("labels.jsonl", state.images.map(i => JSON.stringify(row(i))).join("\\n") + "\\n");
$("stop").onclick = () => fetch("/stop", { method: "POST" });
</script>
"""

EXPORT = "image_path string, width double, height double, names array<string>, boxes array<struct<cls int, x1 double, y1 double, x2 double, y2 double>>"


def label_tool(port: int = 8888, opened=None) -> None:
    """Serves the page on this machine until it is stopped from there. opened: called with the address once the server runs."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._answer(*((200, PAGE.encode()) if self.path in ("/", "/index.html") else (404, b"")))

        def do_POST(self) -> None:
            found = self.path == "/stop"
            self._answer(200 if found else 404, b"")
            if found:
                threading.Thread(target=self.server.shutdown).start()

        def log_message(self, *args) -> None:
            pass

    with ThreadingHTTPServer(("127.0.0.1", port), Handler) as server:
        if opened is not None:
            opened(f"http://127.0.0.1:{server.server_address[1]}/")
        server.serve_forever()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Detections (image_path, det_id, cls, conf, x1, y1, x2, y2) of the page's exports of all images, with confidence 1."""
    rows = spark.read.schema(EXPORT).json(path).select("image_path", F.posexplode("boxes").alias("k", "b"))
    return rows.select("image_path", F.col("k").cast("long").alias("det_id"), "b.cls", F.lit(1.0).alias("conf"), "b.x1", "b.y1", "b.x2", "b.y2")


def label_names(spark: SparkSession, path: str) -> dict[int, str]:
    """Names of the classes, by number, of the export that knows most of them."""
    found = spark.read.schema(EXPORT).json(path).select("names").orderBy(F.size("names").desc(), "names").first()
    return dict(enumerate(found["names"])) if found else {}
