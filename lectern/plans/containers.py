"""Container files around given package documents, as input for the reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa

CONTAINER_XML = (
    '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" '
    'version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" '
    'media-type="application/oebps-package+xml"/></rootfiles></container>')

# Files that are held at once.
PACKED = 64


def container(opf: str, images: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("META-INF/container.xml", CONTAINER_XML)
        archive.writestr("OEBPS/content.opf", opf)
        for name, data in images.items():
            archive.writestr(f"OEBPS/{name}", data)
    return buffer.getvalue()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, modificationTime, length, content) of (path, ctime, opf_xml, cover_bytes, broken)."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACKED):
            some = batch.slice(start, PACKED)
            opf, covers, broken = (some.column(i).to_pylist() for i in (2, 3, 4))
            content = [
                container(x, {f"img/{lang}.png": cover for lang in ("en", "fr", "de", "es")})
                for x, cover in zip(opf, covers)]
            content = [c[: len(c) // 2] if cut else c for c, cut in zip(content, broken)]
            yield pa.record_batch(
                [*some.columns[:2], pa.array([len(c) for c in content], pa.int64()), pa.array(content, pa.binary())],
                names=["path", "modificationTime", "length", "content"])
