"""Manifests that bind a converted data set to its sources."""

from __future__ import annotations

import hashlib
import json
import os

from .fingerprint import file_sha256, files_sha256


class ManifestError(ValueError):
    """A conversion that a manifest cannot vouch for."""


def _record(path: str) -> dict:
    return {"path": os.path.abspath(path), "size_bytes": os.path.getsize(path), "sha256": file_sha256(path)}


def folder_record(spark, path: str) -> dict:
    """path, size_bytes, sha256 and parts of an output of many files in any store that Spark reads.

    Parts are hashed in tasks, a part (below 2 GB) at a time; hidden files and markers are none. The folder's hash is that of its
    parts' lines (relative path, size, hash) in order of path, so it is the same wherever the folder lies.
    """
    found = files_sha256(spark, path).select("path", "size_bytes", "sha256").collect()  # one row a part, which the manifest lists
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/")
    own = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
    parts = sorted(({"path": own(r.path).removeprefix(top).lstrip("/"), "size_bytes": r.size_bytes, "sha256": r.sha256} for r in found), key=lambda p: p["path"])
    if not parts:
        raise ManifestError(f"no files at {path}")
    lines = "".join(f"{p['path']} {p['size_bytes']} {p['sha256']}\n" for p in parts)
    return {"path": path, "size_bytes": sum(p["size_bytes"] for p in parts), "sha256": hashlib.sha256(lines.encode()).hexdigest(), "parts": parts}


def write_manifest(path: str, output: str, sources: list[str], adapter: str, parameters: dict, diagnostics: dict, event_count: int, provenance: dict | None = None, expected_sha256: str | None = None, spark=None) -> dict:
    """Writes and returns the manifest of a conversion and its sources.

    output: a local file, or with spark a folder of parts in any store. A checksum that the provenance or the caller expects must be
    the output's; data marked as a synthetic demonstration are no historical ones, and get no manifest.
    """
    if not spark and not os.path.isfile(output):
        raise ManifestError(f"no output at {output}")
    if (provenance or {}).get("synthetic_demonstration"):
        raise ManifestError("a manifest of ingested data can't have synthetic provenance")
    if not adapter.strip():
        raise ManifestError("a manifest needs the adapter's name")
    if event_count <= 0 or not sources:
        raise ManifestError("a manifest needs events and at least one source")
    made = folder_record(spark, output) if spark else _record(output)
    for wanted in (expected_sha256, (provenance or {}).get("checksum_sha256")):
        if wanted not in (None, made["sha256"]):
            raise ManifestError("the output's checksum is not the expected one")
    read = (lambda s: folder_record(spark, s)) if spark else _record
    manifest = {"schema_version": 1, "provenance": provenance or {}, "output": made | {"event_count": event_count}, "adapter": adapter, "parameters": parameters, "sources": [read(s) for s in sources], "diagnostics": dict(sorted(diagnostics.items()))}
    text = json.dumps(manifest, indent=2, sort_keys=True, default=str)
    if spark:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
    else:
        with open(path, "w") as f:
            f.write(text)
    return manifest


def verify_folder(spark, manifest: dict) -> list[str]:
    """The parts of a manifest's output that are missing, added or changed."""
    before = {p["path"]: p["sha256"] for p in manifest["output"]["parts"]}
    now = {p["path"]: p["sha256"] for p in folder_record(spark, manifest["output"]["path"])["parts"]}
    return sorted(p for p in before.keys() | now.keys() if before.get(p) != now.get(p))
