"""Fetching entries through a provider, with a file cache."""

from __future__ import annotations

import gzip
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import scalars as S

SUFFIXES = (".cif", ".cif.gz")
TIMEOUT = 60


class CacheStaleError(RuntimeError):
    """A cached file is older than allowed and the options say to fail."""


@dataclass(frozen=True)
class FetchOptions:
    """stale_behavior: use_stale, warn (fetch again) or fail."""

    allow_partial: bool = False
    use_cache: bool = True
    decompress: bool = True
    max_age_seconds: float | None = None
    stale_behavior: str = "use_stale"

    def __post_init__(self) -> None:
        if self.stale_behavior not in ("use_stale", "warn", "fail"):
            raise ValueError(f"unknown stale_behavior: {self.stale_behavior}")


def is_stale(age_seconds: float, most: float | None) -> bool:
    return most is not None and age_seconds > most


def cached(folder: str, entry: str, options: FetchOptions, now: datetime) -> Path | None:
    """The file to reuse: plain before compressed; a stale one by ``stale_behavior``."""
    if not options.use_cache:
        return None
    for suffix in SUFFIXES:
        p = Path(folder) / f"{entry.lower()}{suffix}"
        if p.exists():
            if not is_stale(now.timestamp() - p.stat().st_mtime, options.max_age_seconds):
                return p
            if options.stale_behavior == "fail":
                raise CacheStaleError(str(p))
            return p if options.stale_behavior == "use_stale" else None
    return None


def download(url: str) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
            return r.read()
    except (urllib.error.URLError, OSError) as e:
        raise RuntimeError(f"fetching {url} failed: {e}") from e


def fetch_many(spark: SparkSession, entry_ids: list[str], folder: str, provider: str | None = None, source_uri: str | None = None, options: FetchOptions | None = None, fetcher: Callable[[str], bytes] = download, clock: Callable[[], datetime] | None = None) -> DataFrame:
    """(ord, entry_id, provider, source_uri, path, retrieved_at, from_cache, status, message) in the order of the ids.

    Executors fetch; ``folder`` must be one that they share. Without the option allow_partial the first failure raises; with it, failed rows stay
    with their message. ``fetcher`` replaces the network.
    """
    options = options or FetchOptions()
    clock = clock or (lambda: datetime.now(UTC))
    ids = spark.createDataFrame([(i, e) for i, e in enumerate(entry_ids)], "ord int, entry_id string").withColumn("url", S.source_url(F.col("entry_id"), provider, source_uri))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, entry, url in f.itertuples(index=False):
                now = clock()
                try:
                    hit = cached(folder, entry, options, now)
                    if hit is not None:
                        rows.append((k, entry, provider, url, str(hit), datetime.fromtimestamp(hit.stat().st_mtime, UTC).isoformat(), True, "success", None))
                        continue
                    data = fetcher(url)
                    packed = url.endswith(".gz") or data[:2] == b"\x1f\x8b"
                    if packed and options.decompress:
                        data, packed = gzip.decompress(data), False
                        data.decode("utf-8")
                    Path(folder).mkdir(parents=True, exist_ok=True)
                    to = Path(folder) / f"{entry.lower()}{SUFFIXES[packed]}"
                    part = to.with_suffix(to.suffix + ".part")
                    part.write_bytes(data)
                    part.replace(to)
                    rows.append((k, entry, provider, url, str(to), now.isoformat(), False, "success", None))
                except CacheStaleError:
                    raise
                except (RuntimeError, ValueError, OSError) as e:
                    rows.append((k, entry, provider, url, None, now.isoformat(), False, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["ord", "entry_id", "provider", "source_uri", "path", "retrieved_at", "from_cache", "status", "message"])

    t = ids.repartition(min(len(entry_ids), 64) or 1).mapInPandas(run, "ord int, entry_id string, provider string, source_uri string, path string, retrieved_at string, from_cache boolean, status string, message string")
    rows = sorted(t.collect(), key=lambda r: r["ord"])
    bad = [r for r in rows if r["status"] == "failed"]
    if bad and not options.allow_partial:
        raise RuntimeError(bad[0]["message"])
    return spark.createDataFrame(rows, t.schema)


def fetch_pdb(*_args, **_kwargs):
    raise NotImplementedError("the legacy PDB format isn't read")


def stratified(candidates: DataFrame, count: DataFrame, seed: int) -> DataFrame:
    """(bucket, bucket_ord, entry_id) and (bucket, count) -> a sample: an entry belongs to its first bucket; within one, hash order with ``seed``."""
    from pyspark.sql import Window

    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("entry_id").orderBy("bucket_ord"))).filter("_n = 1").drop("_n")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), "entry_id"), "entry_id")
    return first.withColumn("_n", F.row_number().over(order)).join(F.broadcast(count), "bucket").filter("_n <= count").select("bucket", "entry_id")
