"""SVG, EPS and DXF documents of vectorised images.

Input rows: image_id, width, height, layers (name, color, paths of points,
holes and closed, in drawing order). Numbers need exact decimal text, so a
document is written in an Arrow batch, one image a row.
"""

from __future__ import annotations

import hashlib
import io
import math
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..sources.stages import put_whole, small_batches

HEAD = '<?xml version="1.0" encoding="UTF-8" ?>\n<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd">\n'
#: Angles under which joints are straight, the handles' share of a segment, and the length of tiny segments (fixed values).
SHARP, TINY_SHARP, HANDLE, TINY = 58, 38, 0.6, 1.25


def _p(p: dict) -> tuple[float, float]:
    return p["x"], p["y"]


def _xy(x: float, y: float) -> str:
    return f"{fixed(x, 2)} {fixed(y, 2)}"


def polyline_text(points: list[dict]) -> str:
    if not points:
        return ""
    return f"M {_xy(*_p(points[0]))} " + " ".join(f"L {_xy(*_p(p))}" for p in points[1:]) + " Z"


def _length(dx: float, dy: float) -> float:
    return math.sqrt(dx * dx + dy * dy)


def _angle(a, b, c) -> float:
    ax, ay, bx, by = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
    size = _length(ax, ay) * _length(bx, by)
    return 180.0 if size == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (ax * bx + ay * by) / size))))


def _pull(dx: float, dy: float, most: float) -> float:
    """The factor that bounds a handle, whose offset is scaled before it is added: a sum that should be 0 has the same sign as in SQL."""
    d = _length(dx, dy)
    return 1.0 if d <= most or d == 0 else most / d


def bezier_text(points: list[dict], guarded: bool = True) -> str:
    """A closed path of cubics through the points; guarded: handles are bounded and sharp joints straight."""
    n = len(points)
    if n < (5 if guarded else 4):
        return polyline_text(points)
    at = [_p(p) for p in points]
    out = [f"M {_xy(*at[0])}"]
    for i in range(n):
        a, b, c, d = at[i - 1], at[i], at[(i + 1) % n], at[(i + 2) % n]
        ox, oy, tx, ty, one, two = (c[0] - a[0]) / 6, (c[1] - a[1]) / 6, (d[0] - b[0]) / 6, (d[1] - b[1]) / 6, 1.0, 1.0
        if guarded:
            length = lambda p, q: max(0.001, _length(p[0] - q[0], p[1] - q[1]))
            seg = length(b, c)
            least = min(_angle(a, b, c), _angle(b, c, d))
            if least < SHARP or (seg < TINY and least < TINY_SHARP):
                out.append(f"L {_xy(*c)}")
                continue
            one, two = _pull(ox, oy, HANDLE * min(seg, length(a, b))), _pull(tx, ty, HANDLE * min(seg, length(c, d)))
        out.append(f"C {_xy(b[0] + ox * one, b[1] + oy * one)} {_xy(c[0] - tx * two, c[1] - ty * two)} {_xy(*c)}")
    return " ".join(out) + " Z"


def _field(p: dict, name: str):
    return p.get(name) if isinstance(p, dict) else None


def svg_text(width: int, height: int, layers: list[dict], style: str = "grouped") -> str:
    """grouped: a group a layer; flat: paths alone, in reverse order of drawing; plain: groups with unguarded curves and no holes."""
    body = []
    turn = reversed if style == "flat" else iter
    for layer in turn(layers):
        paths = []
        for p in turn(layer["paths"]):
            points, holes, exact = p["points"] or [], _field(p, "holes") or [], _field(p, "svg_path_data")
            fine = [r for r in ([points] if style == "plain" else [points, *holes]) if len(r) >= 3]
            if not exact and not fine:
                continue
            d = exact or " ".join(bezier_text(r, style != "plain") for r in fine)
            tx, ty = _field(p, "tx"), _field(p, "ty")
            if style == "flat":
                paths.append(f'<path fill="{layer["color"]}" d="{d}" transform="translate({fixed(tx or 0.0, 2)}, {fixed(ty or 0.0, 2)})" />')
                continue
            move = f' transform="translate({_xy(tx or 0.0, ty or 0.0)})"' if tx is not None or ty is not None else ""
            paths.append(f'<path fill="{layer["color"]}" opacity="1.00" d="{d}"{move} />')
        body.append("\n".join(paths) if style == "flat" else f'<g id="{layer["color"]}ff">\n' + "\n".join(paths) + "\n</g>")
    shape = "" if style == "flat" else ' shape-rendering="geometricPrecision"'
    return HEAD + f'<svg width="{width}pt" height="{height}pt" viewBox="0 0 {width} {height}" version="1.1" xmlns="http://www.w3.org/2000/svg"{shape}>\n' + "\n".join(b for b in body if b or style != "flat") + "\n</svg>\n"


def eps_text(width: int, height: int, layers: list[dict], style: str = "grouped") -> str:
    """Level 2 EPS: layers in their colour, y turned by the transform; paths with holes are filled even-odd."""
    out = ["%!PS-Adobe-3.0 EPSF-3.0", f"%%BoundingBox: 0 0 {math.ceil(width)} {math.ceil(height)}", "%%LanguageLevel: 2", "%%Pages: 1", "%%EndComments", "gsave", f"0 {height} translate", "1 -1 scale"]
    for layer in layers:
        channels = [int(layer["color"].lstrip("#")[k : k + 2], 16) / 255 for k in (0, 2, 4)]
        out += [f"% Layer: {layer['name']}", " ".join(fixed(c, 4) for c in channels) + " setrgbcolor"]
        for p in layer["paths"]:
            if not p["points"]:
                continue
            holes = [] if style == "plain" else _field(p, "holes") or []
            out.append("newpath")
            for contour in [p["points"], *holes]:
                if contour:
                    out.append(f"{_xy(*_p(contour[0]))} moveto")
                    out += [f"{_xy(*_p(q))} lineto" for q in contour[1:]]
                    if style != "plain":
                        out.append("closepath")
            out.append("closepath fill" if style == "plain" else "eofill" if holes else "fill")
    return "\n".join([*out, "grestore", "showpage", "%%EOF"]) + "\n"


def dxf_text(width: int, height: int, layers: list[dict], style: str = "grouped") -> str:
    """A layer table with layer 0, and a polyline for each ring; y points up."""
    pairs: list[tuple] = [(0, "SECTION"), (2, "HEADER"), (0, "ENDSEC"), (0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (70, len(layers) + 1)]
    for name, color in [("0", 7), *((layer["name"], i % 255 + 1) for i, layer in enumerate(layers))]:
        pairs += [(0, "LAYER"), (2, name), (70, 0), (62, color), (6, "CONTINUOUS")]
    pairs += [(0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")]
    for layer in layers:
        for p in layer["paths"]:
            rings = [p["points"], *([] if style == "plain" else _field(p, "holes") or [])] if p["points"] else []
            for contour in rings:
                if contour:
                    pairs += [(0, "LWPOLYLINE"), (8, layer["name"]), (90, len(contour)), (70, 0 if _field(p, "closed") is False else 1)]
                    for q in contour:
                        pairs += [(10, fixed(q["x"], 4)), (20, fixed(height - q["y"], 4))]
    pairs += [(0, "ENDSEC"), (0, "EOF")]
    return "\n".join(f"{code}\n{value}" for code, value in pairs) + "\n"


#: Images, or texts, that a task turns to Python objects at once, whatever the size of an Arrow batch.
ROWS = 32


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


WRITERS: dict[str, Callable] = {"svg": svg_text, "eps": eps_text, "dxf": dxf_text}


def exports(images: DataFrame, style: str = "grouped", formats: tuple[str, ...] = tuple(WRITERS)) -> DataFrame:
    """(image_id, format, text): a document of each image in each format, from one pass over the images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
            for k in formats:
                texts = pa.array([WRITERS[k](w, h, x or [], style) for w, h, x in rows], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k] * len(rows), pa.string()), texts], names=["image_id", "format", "text"])

    return images.select("image_id", "width", "height", "layers").mapInArrow(run, f"image_id {images.schema['image_id'].dataType.simpleString()}, format string, text string")


def to_svg(images: DataFrame, style: str = "grouped") -> DataFrame:
    """(image_id, text)."""
    return exports(images, style, ("svg",)).drop("format")


def to_eps(images: DataFrame, style: str = "grouped") -> DataFrame:
    return exports(images, style, ("eps",)).drop("format")


def to_dxf(images: DataFrame, style: str = "grouped") -> DataFrame:
    return exports(images, style, ("dxf",)).drop("format")


def write_vectors(texts: DataFrame, folder: str) -> None:
    """Documents as Parquet rows (image_id, text) under format=..., written by the tasks that make them."""
    texts.select("format", "image_id", "text").write.partitionBy("format").mode("overwrite").parquet(folder)


def write_files(texts: DataFrame, folder: str) -> None:
    """Each document as a file image_id.format of the folder, written by the executors through the folder's own file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        for batch in _few(batches):
            for image, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put_whole(store, f"{path}/{image}.{kind}", lambda out, text=text: out.write(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    with small_batches(texts.sparkSession, 8 * ROWS):
        texts.select("image_id", "format", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def file_digests(names: DataFrame, folder: str) -> DataFrame:
    """names (image_id, format and others) with sha256, that of the bytes of the file image_id.format of the folder; null without such a file."""
    kept = [c for c in names.columns if c not in ("image_id", "format")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        def digest(name: str) -> str | None:
            try:
                with store.open_input_stream(f"{path}/{name}") as file:
                    return hashlib.sha256(file.read()).hexdigest()
            except FileNotFoundError:
                return None

        for batch in batches:
            found = [digest(f"{image}.{kind}") for image, kind in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    own = names.select("image_id", F.col("format").cast("string").alias("format"), *kept)
    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "sha256 string"]))


def write_archives(texts: DataFrame, folder: str, shards: int) -> None:
    """All documents in archives shard-00000.zip and so on, each written as a stream by one task; a document's archive is a hash of its image.

    A task holds one document and the archive's list of names; nothing passes
    through the driver. `shards` should grow with the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        rows = ((*r,) for b in _few(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = next(rows, None)
        while held is not None:
            shard, n = held[0], 0

            def fill(out) -> None:
                nonlocal held, n
                with zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_DEFLATED) as z:
                    while held is not None and held[0] == shard:
                        z.writestr(zipfile.ZipInfo(f"{held[1]}.{held[2]}"), held[3], zipfile.ZIP_DEFLATED)
                        n, held = n + 1, next(rows, None)

            put_whole(store, f"{path}/shard-{shard:05d}.zip", fill)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    shard = F.pmod(F.xxhash64("image_id"), F.lit(shards)).cast("int").alias("shard")
    dealt = texts.select(shard, F.col("image_id").cast("string").alias("image_id"), "format", "text").repartition(shards, "shard").sortWithinPartitions("shard", "image_id", "format")
    with small_batches(texts.sparkSession, 8 * ROWS):
        dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


class _Counted:
    """A stream that cannot go back but knows where it is, as archives need."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return False


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, format, text) of the documents in a folder's archives; a task holds some documents of one archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{archive}") as file, zipfile.ZipFile(file) as z:
                    names = z.namelist()
                    for at in range(0, len(names), ROWS):
                        own = names[at : at + ROWS]
                        parts = [n.rpartition(".") for n in own]
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[2] for p in parts]), pa.array([z.read(n).decode() for n in own], pa.string())], names=["image_id", "format", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name")).mapInArrow(run, "image_id string, format string, text string")


def zip_results(texts: DataFrame) -> bytes:
    """One archive of all documents, made on the driver: for the few results of one user's queue."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in texts.orderBy("image_id", "format").toLocalIterator():
            z.writestr(f"{r['image_id']}.{r['format']}", r["text"])
    return out.getvalue()
