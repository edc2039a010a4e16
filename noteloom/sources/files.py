"""Reading single files by their address within tasks, from local and shared file systems."""

from __future__ import annotations

import hashlib
import re

#: Bytes of a file that are in memory at a time.
HASH_BLOCK = 8 * 1024 * 1024


def _open(uri: str):
    from pyarrow import fs

    scheme, authority, path = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):(?://([^/]*))?)?/*(.*)", uri, re.S).groups()
    files, base = (fs.LocalFileSystem(), "") if scheme in (None, "file") else fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return files.open_input_stream(f"{base.rstrip('/')}/{path}")


def file_digest(uri: str) -> str | None:
    """SHA-256 of a file; null if it is gone or can't be read."""
    digest = hashlib.sha256()
    try:
        with _open(uri) as f:
            while block := f.read(HASH_BLOCK):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def read_start(uri: str, size: int) -> tuple[bool, bytes | None]:
    """Whether there is such a file, and its first bytes; null if it can't be read."""
    try:
        with _open(uri) as f:
            return True, f.read(size)
    except FileNotFoundError:
        return False, None
    except OSError:
        return True, None
