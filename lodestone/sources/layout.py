"""OCI image layouts: writing a closure's blobs with manifest and index, reading them back."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER, CONFIG = "application/octet-stream", "application/vnd.oci.empty.v1+json"


def write(blobs: DataFrame, root: str, name: str = "latest") -> str:
    """Writes blobs (title, content) as a layout below a mounted folder; returns the manifest's digest.

    Blobs are written by the tasks that hold them; only titles, digests and sizes reach the
    driver, since one JSON manifest has to list them.
    """
    base = Path(root) / "blobs" / "sha256"
    base.mkdir(parents=True, exist_ok=True)
    target = str(base)

    def put(frames):
        for f in frames:
            for data in f["content"]:
                data = bytes(data)
                (Path(target) / hashlib.sha256(data).hexdigest()).write_bytes(data)
            yield f[["title"]].assign(digest=[hashlib.sha256(bytes(x)).hexdigest() for x in f["content"]], size=[len(x) for x in f["content"]])

    rows = sorted(tuple(r) for r in blobs.select("title", F.col("content").cast("binary").alias("content")).mapInPandas(put, "title string, digest string, size long").collect())

    def save(record: dict) -> tuple[str, int]:
        raw = json.dumps(record, separators=(",", ":")).encode()
        digest = hashlib.sha256(raw).hexdigest()
        (base / digest).write_bytes(raw)
        return digest, len(raw)

    config, size = save({})
    manifest = {"schemaVersion": 2, "mediaType": "application/vnd.oci.image.manifest.v1+json", "config": {"mediaType": CONFIG, "digest": f"sha256:{config}", "size": size}, "layers": [{"mediaType": LAYER, "digest": f"sha256:{d}", "size": n, "annotations": {"org.opencontainers.image.title": t}} for t, d, n in rows]}
    digest, size = save(manifest)
    (Path(root) / "index.json").write_text(json.dumps({"schemaVersion": 2, "manifests": [{"mediaType": manifest["mediaType"], "digest": f"sha256:{digest}", "size": size, "annotations": {"org.opencontainers.image.ref.name": name}}]}))
    (Path(root) / "oci-layout").write_text('{"imageLayoutVersion":"1.0.0"}')
    return f"sha256:{digest}"


def read(spark: SparkSession, root: str) -> DataFrame:
    """title, digest, size, content of the layers of a layout; without a title layer-<i>-<digest>."""
    index = spark.read.json(f"{root}/index.json", multiLine=True).select(F.explode("manifests").alias("m")).select(F.substring_index("m.digest", ":", -1).alias("hex"))
    blobs = spark.read.format("binaryFile").load(f"{root}/blobs/sha256").select(F.substring_index("path", "/", -1).alias("hex"), "content")
    shape = "struct<layers:array<struct<digest:string,size:bigint,annotations:map<string,string>>>>"
    layers = index.join(blobs, "hex").select(F.posexplode(F.from_json(F.col("content").cast("string"), shape)["layers"]).alias("i", "l"))
    hexes = F.substring_index("l.digest", ":", -1)
    title = F.coalesce(F.try_element_at("l.annotations", F.lit("org.opencontainers.image.title")), F.concat(F.lit("layer-"), F.col("i").cast("string"), F.lit("-"), hexes))
    return layers.select(title.alias("title"), hexes.alias("hex"), F.col("l.size").alias("size")).join(blobs, "hex").select("title", F.concat(F.lit("sha256:"), "hex").alias("digest"), "size", "content")
