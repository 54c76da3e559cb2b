"""Readers of binary bodies: typed streams of chat messages and compressed note documents.

Broken input never raises: it gives an empty text or the status ``unsupported``.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

# Opening and text marker of a typed stream, and the bytes a length takes by its first byte.
STREAM, TEXT_MARK = b"\x04\x0bstreamtyped", b"\x84\x01+"
LENGTH_BYTES = {0x81: 2, 0x82: 4, 0x83: 8}
# Paragraph styles of a note, by number, and fields of its document.
HEADINGS = {1: "## ", 2: "### "}
BULLETS, NUMBERED, CHECKBOX, PLAIN = (100, 101), 102, 103, -1
DOCUMENT, NOTE, NOTE_TEXT, NOTE_RUNS = 2, 3, 2, 5
RUN_LENGTH, RUN_STYLE, STYLE_TYPE, STYLE_INDENT, STYLE_CHECK, CHECK_DONE = 1, 2, 1, 4, 5, 2
#: Bytes of an unpacked note document at most; a larger one is unsupported.
MOST_BYTES = 64 << 20


def stream_text(body: bytes | None) -> str:
    """Text of a message kept as a typed stream; '' for null, other and broken bodies."""
    if not body or not body.startswith(STREAM):
        return ""
    _, mark, rest = body.partition(TEXT_MARK)
    if not mark or not rest:
        return ""
    if rest[0] < 0x80:
        size, rest = rest[0], rest[1:]
    else:
        width = LENGTH_BYTES.get(rest[0], 0)
        if not width or len(rest) <= width:
            return ""
        size, rest = int.from_bytes(rest[1 : 1 + width], "little"), rest[1 + width :]
    rest = rest.lstrip(bytes([0, *range(0x80, 0xC0)]))  # fillers; no text in UTF-8 begins with one
    if not 0 < size <= len(rest):
        return ""
    raw = rest[:size]
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    return raw.decode("utf-8", "ignore")


def wire_fields(data: bytes) -> dict[int, list]:
    """Fields of a protocol-buffer message: numbers for varints, bytes for the rest. Raises ``ValueError`` when it is cut off."""
    found: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("cut off within a number")
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            found.setdefault(tag >> 3, []).append(varint())
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}.get(kind)
        if size is None or at + size > len(data):
            raise ValueError("cut off within a field")
        found.setdefault(tag >> 3, []).append(data[at : at + size])
        at += size
    return found


def _inner(fields: dict[int, list], number: int) -> dict[int, list] | None:
    value = fields.get(number, [None])[-1]
    return wire_fields(value) if isinstance(value, bytes) else None


def _number(fields: dict[int, list], number: int, default: int = 0) -> int:
    value = fields.get(number, [default])[-1]
    if not isinstance(value, int):
        raise ValueError("a number was expected")
    return value - (1 << 64) if value >> 63 else value


def _style(run: dict[int, list]) -> tuple[int, int, bool] | None:
    """(type, indent, done) of a run that names a paragraph style."""
    style = _inner(run, RUN_STYLE)
    if style is None:
        return None
    check = _inner(style, STYLE_CHECK)
    return _number(style, STYLE_TYPE, PLAIN), max(0, _number(style, STYLE_INDENT)), bool(check and _number(check, CHECK_DONE))


def note_lines(text: str, runs: list[tuple[int, tuple[int, int, bool] | None]]) -> list[tuple[str, tuple[int, int, bool]]]:
    """Lines of a note with the style each begins with. Runs count UTF-16 units; one without a style goes on in the style before."""
    starts, at, style = [], 0, (PLAIN, 0, False)
    for size, own in runs:
        style = own or style
        starts.append((at, style))
        at += size
    out, place, k, current = [], 0, 0, (PLAIN, 0, False)
    for line in text.split("\n"):
        while k < len(starts) and starts[k][0] <= place:
            current = starts[k][1]
            k += 1
        out.append((line, current))
        place += len(line.encode("utf-16-le")) // 2 + 1
    return out


def markdown(lines: list[tuple[str, tuple[int, int, bool]]]) -> str:
    """Lines as Markdown: headings, lists, numbers that go on while numbered lines follow one another, and check boxes."""
    out = []
    for kind, part in groupby(lines, key=lambda x: x[1][0]):
        for n, (line, (_, indent, done)) in enumerate(part, 1):
            mark = HEADINGS.get(kind, "- " if kind in BULLETS else f"{n}. " if kind == NUMBERED else f"- [{'x' if done else ' '}] " if kind == CHECKBOX else "")
            deep = "  " * indent if kind in (*BULLETS, NUMBERED, CHECKBOX) else ""
            out.append(f"{deep}{mark}{line}" if line.strip() else line)
    return "\n".join(out).rstrip("\n")


def note_text(data: bytes | None) -> tuple[str, str]:
    """(status, Markdown) of a compressed note document: decoded, missing for null and empty, or unsupported."""
    if not data:
        return "missing", ""
    try:
        if data[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as z:
                raw = z.read(MOST_BYTES + 1)
        elif data[:1] == b"\x78":
            raw = zlib.decompressobj().decompress(data, MOST_BYTES + 1)
        else:
            raw = data
        if len(raw) > MOST_BYTES or raw[:6] == b"bplist":
            return "unsupported", ""
        note = _inner(_inner(wire_fields(raw), DOCUMENT) or {}, NOTE)
        if note is None or NOTE_TEXT not in note:
            return "unsupported", ""
        runs = [wire_fields(x) for x in note.get(NOTE_RUNS, [])]
        text = note[NOTE_TEXT][-1].decode("utf-8")
        return "decoded", markdown(note_lines(text, [(_number(r, RUN_LENGTH), _style(r)) for r in runs]))
    except (ValueError, OSError, EOFError, zlib.error, AttributeError, TypeError):
        return "unsupported", ""


def decoded_notes(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, text_status, text) of compressed note documents; a text that couldn't be read is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [note_text(x) for x in b[body]]
            yield pd.DataFrame({key: b[key], "text_status": [s for s, _ in got], "text": [t if s == "decoded" else None for s, t in got]})

    return rows.select(key, body).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, text_status string, text string")


def decoded_messages(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, text) of messages kept as typed streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [stream_text(x) for x in b[body]]})

    return rows.select(key, body).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, text string")
