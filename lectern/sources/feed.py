"""Catalogue feed files."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.catalog import DIR_MIME, FEED_SPACES


def feed_head(catalog_id: str, title: str, href: str, updated: datetime.datetime) -> str:
    """Opening tag and leading elements of a feed document."""
    spaces = " ".join(f"{name}={quoteattr(value)}" for name, value in FEED_SPACES.items())
    links = "".join(
        f"<link href={quoteattr(href)} type={quoteattr(DIR_MIME)} rel={quoteattr(rel)}/>"
        for rel in ("start", "self"))
    return (f"<feed {spaces}><id>{escape(catalog_id)}</id><title>{escape(title)}</title>"
            f"<updated>{updated:%Y-%m-%dT%H:%M:%SZ}</updated>{links}")


def write_feed(entries: DataFrame, path: str, catalog_id: str, title: str, href: str) -> None:
    """Write feed entries as feed documents, one per task.

    Every document has the whole head, so a large catalogue becomes many files and passes through no
    single task.
    """
    head = feed_head(catalog_id, title, href, datetime.datetime.now(datetime.timezone.utc))

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        yield from batches
        yield pd.DataFrame({"value": ["</feed>"]})

    entries.select(
        F.to_xml(F.struct(*entries.columns), {"rowTag": "entry"}).alias("value")
    ).mapInPandas(document, "value string").write.mode("overwrite").text(path)
