"""Files in storage that driver and executors share, for Python code that Spark runs on either."""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it of a local path or a URI that Arrow's file systems know."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder, by name; hidden ones and marks of jobs are left out."""
    store, at = located(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    root = path.rstrip("/")
    named = [(f"{root}/{f.path[len(at.rstrip('/')) + 1 :]}", f.size) for f in found if f.type == fs.FileType.File]
    return sorted((p, n) for p, n in named if not any(part[:1] in "._" for part in p[len(root) + 1 :].split("/")))


def publish(path: str, content: bytes) -> bool:
    """Write a file that appears whole or not at all; False where it is there already, which then stays."""
    store, at = located(path)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        return False
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    hidden = f"{at.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, at)
    return True
