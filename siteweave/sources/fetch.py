"""Pages over HTTP, fetched by tasks; tests use a loopback server or a snapshot table instead."""

from __future__ import annotations

import gzip
import heapq
import itertools
import json
import time
import urllib.error
import urllib.request
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"
TIMEOUT, CONCURRENCY = 10.0, 10
SCHEMA = "url string, html string, content_length long, elapsed_ms float, status_code int, error boolean"


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.last: int | None = None

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.last = code
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch_one(url: str, timeout: float = TIMEOUT) -> dict:
    """Redirects are followed: the page keeps the URL asked for and the last redirect's status. Failures are error rows."""
    began, redirects = time.monotonic(), _Redirects()
    out = {"url": url, "html": None, "content_length": None, "elapsed_ms": None, "status_code": None, "error": True}
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        with urllib.request.build_opener(redirects).open(request, timeout=timeout) as r:
            body, length = r.read(), r.headers.get("Content-Length")
            if body[:2] == b"\x1f\x8b":  # sitemaps may be compressed files
                body = gzip.decompress(body)
            charset = r.headers.get_content_charset() or "utf-8"
            out |= {"html": body.decode(charset, "replace"), "content_length": int(length) if length and length.isdigit() else None, "elapsed_ms": (time.monotonic() - began) * 1000, "status_code": redirects.last or r.status, "error": False}
    except urllib.error.HTTPError as e:
        out["status_code"] = e.code
    except (OSError, ValueError, LookupError, EOFError, zlib.error):
        pass
    return out


COLUMNS = [("url", pa.string()), ("html", pa.string()), ("content_length", pa.int64()), ("elapsed_ms", pa.float32()), ("status_code", pa.int32()), ("error", pa.bool_())]


class Fetched:
    """What the attempts of one task have fetched: a file for each attempt, a line for each page as soon as it is there."""

    def __init__(self, folder: str, part: int) -> None:
        self.files, self.path = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        self.files.create_dir(self.path)
        self.rows: dict[str, dict] = {}
        prefix = f"part-{part:05d}-"
        for info in self.files.get_file_info(pa.fs.FileSelector(self.path)):
            if info.base_name.startswith(prefix):
                with self.files.open_input_stream(info.path) as f:
                    for line in f.read().decode("utf-8", "replace").split("\n")[:-1]:  # the last line may be cut off
                        row = json.loads(line)
                        self.rows[row["url"]] = row
        self.out = self.files.open_output_stream(f"{self.path}/{prefix}{uuid.uuid4().hex[:12]}.jsonl")

    def add(self, row: dict) -> None:
        self.out.write(json.dumps(row).encode() + b"\n")
        self.out.flush()

    def close(self) -> None:
        self.out.close()


def in_turn(urls: list[str], delay: float) -> Iterator[str]:
    """URLs host by host in turn, with ``delay`` seconds at least from one URL of a host to its next; sleeps as long as
    no host is due."""
    queues: dict[str, deque[str]] = {}
    for url in urls:
        queues.setdefault((urlsplit(url).hostname or "").lower(), deque()).append(url)
    due = [(0.0, i, host) for i, host in enumerate(queues)]
    while due:
        at, i, host = heapq.heappop(due)
        wait = at - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        yield queues[host].popleft()
        if queues[host]:
            heapq.heappush(due, (time.monotonic() + delay, i, host))


def http_fetch(*, concurrency: int = CONCURRENCY, delay_ms: int = 0, timeout: float = TIMEOUT, ledger: str | None = None, one: Callable[[str, float], dict] = fetch_one) -> Callable[[DataFrame], DataFrame]:
    """A function from (url) to fetched rows, with at most ``concurrency`` requests at a time.

    All URLs of a host go to one task, so that ``delay_ms`` lies between requests to a host whatever the number of tasks;
    a task asks its hosts in turn. ``ledger`` is a folder that all tasks share: pages are noted there as they come, and a
    task that is started anew, or a job with the same ledger, takes them from there instead of asking again. Failures
    are noted too. A URL that comes twice is asked for once. Each call of the function has a folder of its own in it.
    """
    calls = itertools.count()

    def fetch(urls: DataFrame) -> DataFrame:
        folder = f"{ledger.rstrip('/')}/call={next(calls):06d}" if ledger else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            notes = Fetched(folder, TaskContext.get().partitionId()) if folder else None
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in COLUMNS], [k for k, _ in COLUMNS])
            try:
                asked = [u for batch in batches for u in batch.column(0).to_pylist()]
                known = notes.rows if notes else {}
                had = [known[u] for u in dict.fromkeys(asked) if u in known]
                if had:
                    yield made(had)
                rows: list[dict] = []
                for url in in_turn([u for u in dict.fromkeys(asked) if u not in known], delay_ms / 1000):
                    rows.append(one(url, timeout))
                    if notes:
                        notes.add(rows[-1])
                    if len(rows) >= 64:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)
            finally:
                if notes:
                    notes.close()

        host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
        return urls.select("url").filter("url IS NOT NULL").repartition(concurrency, host).mapInArrow(run, SCHEMA)

    return fetch
