"""Fetching a month's dump before Spark reads it: on the driver, a stream, resumed where it stopped."""

from __future__ import annotations

import urllib.error
import urllib.request
from pathlib import Path

CHUNK = 1 << 20


def month_url(template: str, month: str) -> str:
    """The address of a month such as 2026-04, by a template with {month}."""
    return template.format(month=month)


def _length(url: str) -> int | None:
    head = urllib.request.Request(url, method="HEAD")
    with urllib.request.urlopen(head, timeout=30) as answer:
        told = answer.headers.get("Content-Length", "")
    return int(told) if told.isdigit() else None


def _total(error: urllib.error.HTTPError) -> int | None:
    """The whole size that a refused range tells: `Content-Range: bytes */1234`."""
    told = (error.headers.get("Content-Range") or "").rpartition("/")[2]
    return int(told) if told.isdigit() else None


def _append(url: str, out: Path, start: int) -> None:
    """What follows byte `start` of `url`, behind it in `out`; all of it from 0 where the server knows no ranges."""
    ask = urllib.request.Request(url, headers={"Range": f"bytes={start}-"} if start else {})
    with urllib.request.urlopen(ask, timeout=60) as answer:
        with out.open("r+b" if out.exists() else "wb") as f:
            f.seek(start if answer.status == 206 else 0)
            f.truncate()
            while block := answer.read(CHUNK):
                f.write(block)


def download(url: str, path: str, force: bool = False) -> str:
    """Fetches `url` to `path`: nothing if it is there whole, the rest if a part is, all
    anew by `force` or if what is there is longer. A server that tells no size says by refusing the range (416) that nothing is left."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    have = out.stat().st_size if out.exists() and not force else 0
    size = _length(url)
    if size is not None and have > size:
        have = 0
    if have and have == size:
        return path
    try:
        _append(url, out, have)
    except urllib.error.HTTPError as e:
        if e.code != 416 or not have:
            raise
        if _total(e) != have:
            _append(url, out, 0)
    return path
