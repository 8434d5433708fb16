"""Files opened by tasks, on the stores that Arrow knows by itself."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs

# Schemes of Spark's paths that Arrow opens without a client library of its own, as Arrow names them.
ARROW_SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def scheme_of(path: str) -> str:
    """The scheme of a path as Spark lists it; a bare path is a local one."""
    head, colon, _ = path.partition(":")
    return head.lower() if colon and "/" not in head else "file"


def opens(path: str) -> bool:
    return scheme_of(path) in ARROW_SCHEMES


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it."""
    scheme = scheme_of(path)
    if scheme not in ARROW_SCHEMES:
        raise ValueError(f"no file system of Arrow for {scheme}: {path}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    rest = path.split("://", 1)[1]
    store, _ = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}://{quote(rest)}")
    return store, rest
