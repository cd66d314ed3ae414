"""Result archives: members are checked before anything is unpacked; rows are then validated as a frame."""

from __future__ import annotations

import hashlib
import json
import stat
import zipfile
from pathlib import Path, PurePosixPath

MOST_BYTES, MOST_RATIO, MOST_MEMBERS = 2 << 30, 200, 10_000


def unsafe_members(path: str, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> list[str]:
    """Why an archive must not be unpacked: traversal, links, nested archives, repeated names, sizes."""
    out, seen, total = [], set(), 0
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        if len(infos) > MOST_MEMBERS:
            out.append("too many members")
        for i in infos:
            p = PurePosixPath(i.filename)
            if p.is_absolute() or ".." in p.parts or "\\" in i.filename:
                out.append(f"{i.filename}: leaves the folder")
            if stat.S_ISLNK(i.external_attr >> 16):
                out.append(f"{i.filename}: a link")
            if p.suffix.lower() in (".zip", ".tar", ".gz", ".7z"):
                out.append(f"{i.filename}: an archive")
            if i.filename in seen:
                out.append(f"{i.filename}: twice")
            seen.add(i.filename)
            total += i.file_size
            if i.compress_size and i.file_size / i.compress_size > most_ratio and i.file_size > 1 << 20:
                out.append(f"{i.filename}: expands too much")
        if total > most_bytes:
            out.append("too large")
    return out


def wrong_checksums(path: str, listing: str = "checksums.json") -> list[str]:
    """Members whose SHA-256 differs from the listing, or that only one of the two has."""
    with zipfile.ZipFile(path) as z:
        want = json.loads(z.read(listing))
        have = {n for n in z.namelist() if n != listing and not n.endswith("/")}
        out = sorted(have ^ set(want))
        return out + [n for n in sorted(have & set(want)) if hashlib.sha256(z.read(n)).hexdigest() != want[n]]


def unpack(path: str, folder: str) -> list[str]:
    """Unpack a safe archive; the names of its members."""
    if bad := unsafe_members(path):
        raise ValueError("; ".join(bad))
    with zipfile.ZipFile(path) as z:
        z.extractall(folder)
        return z.namelist()


def pack(files: dict[str, bytes], path: str) -> None:
    """An archive whose bytes depend on the files alone."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            z.writestr(info, files[name])


def read_members(spark, path: str, folder: str, suffix: str = ".jsonl"):
    """Rows of all members of a suffix, read by Spark from the folder they were unpacked to."""
    names = [str(Path(folder) / n) for n in unpack(path, folder) if n.endswith(suffix)]
    return spark.read.json(names, mode="FAILFAST")
