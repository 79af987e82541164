"""Bodies by key: from a folder where they are kept as they came, or asked for and put there.

Keys are numbers, identifiers, references or URLs in a DataFrame, so what is fetched can be chosen by any query, found by a search (`paged`), or
listed. A body is written once, whole, before it is used: a lost task or a second run doesn't ask again.
"""

from __future__ import annotations

import re
import time
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fetch modes: only what isn't kept, nothing, everything again.
MISSING, NEVER, ALWAYS = "missing", "never", "always"


class Bodies:
    """A folder (a URI that all tasks reach) of bodies."""

    def __init__(self, folder: str, fetch: str = MISSING, pause: float = 0.3, timeout: float = 60, accept: str = "*/*") -> None:
        if fetch not in (MISSING, NEVER, ALWAYS):
            raise ValueError("fetch is missing, never or always")
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.fetch, self.pause, self.timeout, self.accept = fetch, pause, timeout, accept

    def get(self, name: str, url: str | None) -> bytes:
        from pyarrow import fs

        path = f"{self.folder}/{name}"
        if self.fetch != ALWAYS and self.store.get_file_info(path).type == fs.FileType.File:
            with self.store.open_input_stream(path) as f:
                return f.read()
        if self.fetch == NEVER or url is None:
            raise FileNotFoundError(f"{name} isn't kept")
        time.sleep(self.pause)
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": self.accept}), timeout=self.timeout) as answer:
            raw = answer.read()
        self.put(name, raw)
        return raw

    def put(self, name: str, raw: bytes) -> None:
        self.store.create_dir(self.folder, recursive=True)
        part = f"{self.folder}/.{name}.{time.time_ns()}"  # two tries of a task don't write into one file
        with self.store.open_output_stream(part) as f:
            f.write(raw)
        self.store.move(part, f"{self.folder}/{name}")


def sanitised(key: str, length: int = 80) -> str:
    """A file's name of a key or URL, as `functions.columns.cache_key` makes it."""
    return re.sub(r"[^A-Za-z0-9]+", "_", key)[:length]


def fetched(keys: DataFrame, folder: str, *, key_col: str, url: str | None = None, fetch: str = MISSING, pause: float = 0.3, timeout: float = 60, suffix: str = "") -> DataFrame:
    """doc_id (the key), raw, error of every key: the body, or why there is none.

    `url` is a template with {key}; without one, keys are URLs themselves. Two keys with one sanitised name share a body: give keys that differ in
    their first 80 letters and digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = Bodies(folder, fetch, pause, timeout)
        for batch in batches:
            raw, error = [], []
            for key in batch.column(0).to_pylist():
                try:
                    if key is None:
                        raise ValueError("no key")
                    raw.append(bodies.get(sanitised(key) + suffix, key if url is None else url.format(key=key)))
                    error.append(None)
                except (OSError, ValueError) as e:
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(error, pa.string())], ["doc_id", "raw", "error"])

    return keys.select(F.col(key_col).cast("string").alias("doc_id")).mapInArrow(run, "doc_id string, raw binary, error string")


def discovered(pages: DataFrame, path: str, *, item_col: str = "item") -> DataFrame:
    """key: the identifiers that a search's items name at a JSON path, each once."""
    return pages.select(F.get_json_object(item_col, path).alias("key")).where("key is not null").distinct()
