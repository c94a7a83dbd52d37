"""Reports on archives: what lies where, table and chain, findings, hexdumps, decoded fields, as text and as one HTML page."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from stratabox.functions import hashing
from stratabox.sources import format as fmt
from stratabox.sources.archive import VIEWS
from stratabox.sources.verdicts import entry_errors

from . import decode
from .layout import GLYPHS

WIDTH = 64
STYLE = "body{font-family:monospace}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px;text-align:left}.ERROR{color:#a00}.WARN{color:#850}"


class Report:
    """One archive, walked once: regions with gaps, blocks with verdicts, findings, and fields of its partitions."""

    def __init__(self, data: bytes, verify: bool = True, registry: decode.Registry | None = None):
        self.data, self.verify, self.registry = data, verify, registry or decode.Registry()
        self.found = fmt.walk(data)
        regions = sorted((r[1:7] for r in VIEWS["regions"]("", data, self.found)), key=lambda r: (r[0], r[1]))
        self.regions: list[tuple[int, int, str, str]] = []  # start, end, kind, label
        self.overlaps: list[tuple[int, int]] = []
        covered = 0
        for start, size, kind, label, _, end in regions:
            if start > covered:
                self.regions.append((covered, start, "gap", ""))
            elif start < covered:
                self.overlaps.append((start, min(covered - start, size)))
            self.regions.append((start, end, kind, label or ""))
            covered = max(covered, end)
        if self.found.version and covered < len(data):
            self.regions.append((covered, len(data), "gap", ""))

    # --- text

    def strip(self, width: int = WIDTH) -> str:
        """The file in `width` cells, each showing the last region that touches it."""
        cells, size = ["."] * width, max(1, len(self.data))
        for start, end, kind, _ in self.regions:
            if end > start:
                for k in range(start * width // size, min(width - 1, (end - 1) * width // size) + 1):
                    cells[k] = GLYPHS.get(kind, "?")
        return "".join(cells)

    def layout_lines(self) -> Iterator[str]:
        yield f"file: {len(self.data)} bytes, version {'.'.join(map(str, self.found.version or ()))}, first block {self.found.head} ({self.found.head_source})"
        for start, end, kind, label in self.regions:
            yield f"{start:>10}  {end:>10}  {kind:<12} {label}".rstrip()

    def table_lines(self) -> Iterator[str]:
        for k, b in enumerate(self.found.blocks):
            errors = entry_errors(self.data, b.entries) if self.verify else [None] * len(b.entries)
            for slot, (p, error) in enumerate(zip(b.entries, errors, strict=True)):
                yield f"{k:>4}.{slot:<3} {p.uid.hex()} {p.type:08x} {p.start:>10} {p.used:>10} {p.max - p.used:>8} {hashing.NAMES.get(p.algo, '?'):<8} {error or 'ok':<18} {fmt.decode_label(p.label) or '?'}"

    def chain_lines(self) -> Iterator[str]:
        for k, b in enumerate(self.found.blocks):
            n = hashing.LENGTHS[b.algo]
            state = "" if not self.verify else "ok" if fmt.block_hash(b.algo, b.image)[:n] == b.hash[:n] else "TableHashMismatch"
            yield f"block {k} at {b.offset}: {b.count} entries, next {b.next}, {hashing.NAMES[b.algo]} {state}".rstrip()

    def finding_lines(self) -> Iterator[str]:
        for severity, kind, message, _ in self.found.problems:
            yield f"{severity:<5} {kind}: {message}"
        for start, size in self.overlaps:
            yield f"WARN  Overlap: {size} bytes at {start}"
        for start, end, kind, _ in self.regions:
            if kind == "gap":
                yield f"INFO  Gap: {end - start} bytes at {start}"

    def field_lines(self, uid: str = "", label: str = "", decoder: str | None = None) -> Iterator[str]:
        for p in self.found.parts:
            if p.uid.hex().startswith(uid) and label in (fmt.decode_label(p.label) or ""):
                yield f"{p.uid.hex()} {fmt.decode_label(p.label) or ''}".rstrip()
                for _, (path, value, *_rest, note) in self.registry.nested(p.type, fmt.data_of(self.data, p), decoder):
                    text = value.hex() if isinstance(value, bytes) else str(value)
                    yield f"  {'.'.join(path)} = {text}" + (f"  ({note})" if note else "")

    def hexdump_lines(self, region: str = "", span: tuple[int, int] | None = None, most: int | None = None) -> Iterator[str]:
        """Of a span of bytes, or of regions by kind, part of the label, or first digits of the uid."""
        if span:
            yield from dump(self.data[span[0] : span[1]], span[0], most)
            return
        uids = {(p.start, p.used): p.uid.hex() for p in self.found.parts}
        for start, end, kind, label in self.regions:
            if not region or region == kind or (label and region in label) or uids.get((start, end - start), "").startswith(region):
                yield f"{start:#x}..{end:#x}  {kind}  {label}".rstrip()
                yield from dump(self.data[start:end], start, most)

    # --- HTML

    def html(self, title: str) -> str:
        rows = lambda lines: "<pre>" + escape("\n".join(lines)) + "</pre>"
        table = "".join(f"<tr><td>{s}</td><td>{e}</td><td>{k}</td><td>{escape(x)}</td></tr>" for s, e, k, x in self.regions)
        findings = "".join(f'<li class="{x.split()[0]}">{escape(x)}</li>' for x in self.finding_lines())
        return (
            f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>'
            f"<h2>bytes</h2><pre>{self.strip()}</pre><table><tr><th>from</th><th>to</th><th>kind</th><th>label</th></tr>{table}</table>"
            f"<h2>partitions</h2>{rows(self.table_lines())}<h2>chain</h2>{rows(self.chain_lines())}<h2>fields</h2>{rows(self.field_lines())}<h2>findings</h2><ul>{findings}</ul></body></html>\n"
        )


def dump(data: bytes, base: int, most: int | None = None) -> Iterator[str]:
    shown = data if most is None else data[:most]
    for at in range(0, len(shown), 16):
        piece = shown[at : at + 16]
        yield f"{base + at:08x}  {piece[:8].hex(' '):<23}  {piece[8:].hex(' '):<23}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in piece)}|"
    if len(shown) < len(data):
        yield f"... {len(data) - len(shown)} more bytes"


def html_reports(archives: DataFrame, verify: bool = True) -> DataFrame:
    """path, html: a self-contained page for each archive. One walk of each file, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([Report(content.as_py() or b"", verify).html(path)], pa.string())], ["path", "html"])

    return archives.select("path", "content").mapInArrow(run, "path string, html string")


def text_reports(archives: DataFrame, parts: tuple[str, ...] = ("layout", "table", "chain", "finding")) -> DataFrame:
    """path, part, line_no, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Report(content.as_py() or b"")
                rows = [(path, part, k, line) for part in parts for k, line in enumerate(getattr(own, f"{part}_lines")())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["path", "part", "line_no", "line"])

    return archives.select("path", "content").mapInArrow(run, "path string, part string, line_no int, line string")
