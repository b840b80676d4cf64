"""Tables at rest: staged writes with a manifest last, the space, and codecs."""

from __future__ import annotations

import json
import struct
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songfield.schemas import BLOCK_WEIGHTS
from songfield.sources.snapshots import commit
from songfield.sources.snapshots import tables as snapshot

FORMAT = "space-2"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one machine gets a
    temporary one; on a cluster that is an error, as no other machine sees it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="songfield-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/songfield/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_space(rows: DataFrame, folder: str, blocks: list[dict], built_at: str, pca: tuple | None = None) -> int:
    """The rows (track_id, row_no, raw), the PCA model and the manifest as one
    commit: a reader during a rebuild has the old space or the new one."""
    spark = rows.sparkSession
    parts = {"rows": rows.select("track_id", "row_no", "raw")}
    if pca is not None:
        mean, axes = pca
        parts["pca"] = spark.createDataFrame([([float(x) for x in mean], [[float(x) for x in a] for a in axes])], "mean array<double>, components array<array<double>>")
    manifest = {"format": FORMAT, "built_at": built_at, "n_dims": blocks[-1]["end"] if blocks else 0, "blocks": blocks, "weights": BLOCK_WEIGHTS}
    return commit(spark, folder, parts, manifest)


def open_space(spark: SparkSession, folder: str, number: int | None = None) -> tuple[DataFrame, dict]:
    """The rows and the manifest; refuses another format, blocks that don't
    cover the row, and rows of another width."""
    parts, manifest = snapshot(spark, folder, number)
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']}, not {FORMAT}")
    at = 0
    for block in manifest["blocks"]:
        if block["start"] != at:
            raise ValueError(f"block {block['name']} starts at {block['start']}, not {at}")
        at = block["end"]
    if at != manifest["n_dims"]:
        raise ValueError(f"blocks end at {at}, rows at {manifest['n_dims']}")
    rows = parts["rows"]
    if not rows.filter(F.size("raw") != at).isEmpty():
        raise ValueError(f"rows of another width than {at}")
    return rows, manifest


def pca_model(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components, whose lengths must agree."""
    row = snapshot(spark, folder)[0]["pca"].first()
    mean, axes = np.array(row["mean"]), np.array(row["components"])
    if axes.ndim != 2 or axes.shape[1] != len(mean):
        raise ValueError("components and mean differ in length")
    return mean, axes


def replace_layout(layout: DataFrame, folder: str) -> int:
    """The whole layout at once, as one commit."""
    return commit(layout.sparkSession, folder, {"layout": layout.select("track_id", "x", "y")})


def layout_of(spark: SparkSession, folder: str) -> DataFrame:
    """The layout that is current."""
    return snapshot(spark, folder)[0]["layout"]


def add_columns(rows: DataFrame, schema) -> DataFrame:
    """Additive migration: columns that a table of an older kind lacks are null."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.unionByName(empty, allowMissingColumns=True).select(*empty.columns)


def converted_legacy(rows: DataFrame, schema: str) -> DataFrame:
    """Legacy JSON to typed columns; what can't be read is dropped from the
    row, and no row keeps the text."""
    parsed = rows.withColumn("legacy", F.from_json("legacy_json", schema))
    return parsed.withColumn("legacy_json", F.lit(None).cast("string"))


# --- codecs of payloads that clients read: a few bytes a row, for bounded selections ----


def encode_points(rows) -> bytes:
    """Ids as f64, places as f32 pairs, genres as u16, column after column."""
    ids, xs, ys, genres = zip(*rows) if rows else ((), (), (), ())
    xy = np.stack([np.array(xs, "<f4"), np.array(ys, "<f4")], axis=1) if rows else np.zeros((0, 2), "<f4")
    return struct.pack("<I", len(rows)) + np.array(ids, "<f8").tobytes() + xy.tobytes() + np.array(genres, "<u2").tobytes()


def decode_points(data: bytes) -> list[tuple]:
    (n,) = struct.unpack_from("<I", data)
    if len(data) != 4 + n * 18:
        raise ValueError("body of another length")
    ids = np.frombuffer(data, "<f8", n, 4)
    xy = np.frombuffer(data, "<f4", 2 * n, 4 + 8 * n).reshape(n, 2)
    genres = np.frombuffer(data, "<u2", n, 4 + 16 * n)
    return [(int(i), float(x), float(y), int(g)) for i, (x, y), g in zip(ids, xy, genres)]


def encode_labels(head: dict, labels: list[str]) -> bytes:
    """A JSON head, then one label a line; a line end in a label is a space."""
    body = "\n".join(x.replace("\n", " ") for x in labels).encode()
    top = json.dumps(head).encode()
    return struct.pack("<I", len(top)) + top + body


def decode_labels(data: bytes) -> tuple[dict, list[str]]:
    (n,) = struct.unpack_from("<I", data)
    body = data[4 + n :].decode()
    return json.loads(data[4 : 4 + n]), body.split("\n") if body else []


def encode_ragged(ids: list[int], starts: list[list[float]], rows: list[list[list[int]]], dims: int) -> bytes:
    """S11, S10's rows: for each id any number of quantised rows, by counts."""
    counts = np.array([len(r) for r in rows], "<u2")
    flat = np.array([x for r in rows for v in r for x in v], "i1")
    times = np.array([x for s in starts for x in s], "<f4")
    return struct.pack("<III", len(ids), int(counts.sum()), dims) + np.array(ids, "<f8").tobytes() + counts.tobytes() + times.tobytes() + flat.tobytes()


def decode_ragged(data: bytes):
    n, total, dims = struct.unpack_from("<III", data)
    if len(data) != 12 + n * 10 + total * (4 + dims):
        raise ValueError("body of another length")
    ids = np.frombuffer(data, "<f8", n, 12).astype(int).tolist()
    counts = np.frombuffer(data, "<u2", n, 12 + 8 * n).astype(int)
    if counts.sum() != total:
        raise ValueError("counts don't sum to the rows")
    times = np.frombuffer(data, "<f4", total, 12 + 10 * n)
    flat = np.frombuffer(data, "i1", total * dims, 12 + 10 * n + 4 * total).reshape(total, dims)
    ends = np.cumsum(counts)
    return [(i, times[e - c : e].tolist(), flat[e - c : e].tolist()) for i, c, e in zip(ids, counts, ends)]


def encode_vectors(rows: list[dict], dims: int) -> bytes:
    """A head with names, then the quantised rows; U+001F parts names."""
    names = "\x1f".join(r["name"].replace("\x1f", " ") for r in rows)
    return encode_labels({"n": len(rows), "dims": dims, "names": names}, []) + encode_ragged([r["id"] for r in rows], [[0.0]] * len(rows), [[r["row"]] for r in rows], dims)


def decode_vectors(data: bytes) -> list[dict]:
    (n,) = struct.unpack_from("<I", data)
    head = json.loads(data[4 : 4 + n])
    names = head["names"].split("\x1f") if head["n"] else []
    return [{"id": i, "name": name, "row": rows[0]} for (i, _, rows), name in zip(decode_ragged(data[4 + n :]), names)]
