"""Binary readers on bodies written here."""

import gzip
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from garner.sources import binary


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        if not n:
            return out + bytes([low])
        out += bytes([low | 0x80])


def part(number, value):
    return varint(number << 3) + varint(value & (1 << 64) - 1) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def style(kind, indent=0, done=None):
    return part(2, part(1, kind) + part(4, indent) + (b"" if done is None else part(5, part(1, b"id") + part(2, int(done)))))


def note(text, *runs):
    body = part(2, text.encode()) + b"".join(part(5, part(1, size) + more) for size, more in runs)
    return part(2, part(1, 0) + part(3, body))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (note("Title\nHead\nSub\nplain", (6, style(0)), (5, style(1)), (4, style(2)), (5, style(-1))), "Title\n## Head\n### Sub\nplain"),
        (note("a\nb\nc\nd\ne", (4, style(100)), (4, style(102)), (1, style(-1))), "- a\n- b\n1. c\n2. d\ne"),
        (note("a\nx\nb", (2, style(102)), (2, style(-1)), (1, style(102))), "1. a\nx\n1. b"),
        (note("done\ntodo", (5, style(103, 0, True)), (4, style(103, 0, False))), "- [x] done\n- [ ] todo"),
        (note("top\nin", (4, style(100)), (2, style(101, 2))), "- top\n    - in"),
        (note("😀a\nb", (4, style(103, 0, True)), (1, style(-1))), "- [x] 😀a\nb"),
        (note("bold and\nplain", (4, style(1)), (4, b""), (6, style(-1))), "## bold and\nplain"),
        (note(""), ""),
    ],
)
def test_notes(raw, want):
    for packed in (raw, gzip.compress(raw), zlib.compress(raw)):
        assert binary.note_text(packed) == ("decoded", want)


def test_notes_that_cannot_be_read():
    whole = gzip.compress(note("text", (4, style(1))))
    assert binary.note_text(None) == binary.note_text(b"") == ("missing", "")
    for bad in (b"bplist00xxxx", b"\x1f\x8bnothing", b"\x78\x9cnothing", whole[:-12], part(2, b""), part(1, 5), note("x")[:-1], part(2, part(3, part(2, b"\xff\xff")))):
        assert binary.note_text(bad) == ("unsupported", "")


@given(st.binary(max_size=200))
def test_noise_never_raises(data):
    assert binary.note_text(data)[0] in ("decoded", "missing", "unsupported")
    assert isinstance(binary.stream_text(data), str) and isinstance(binary.stream_text(binary.STREAM + b"x" + binary.TEXT_MARK + data), str)


def stream(text, head=None):
    raw = text if isinstance(text, bytes) else text.encode()
    return binary.STREAM + b"\x81\xe8\x03NSString" + binary.TEXT_MARK + (bytes([len(raw)]) if head is None else head) + raw + b"\x86tail"


def test_streams():
    assert binary.stream_text(stream("Grüße 😀")) == "Grüße 😀"
    long = "ab" * 40_000
    assert binary.stream_text(stream(long, b"\x82" + len(long).to_bytes(4, "little"))) == long
    assert binary.stream_text(stream("x" * 300, b"\x81" + (300).to_bytes(2, "little") + b"\x00\x92")) == "x" * 300
    assert binary.stream_text(stream("hi".encode("utf-16"))) == "hi"
    for bad in (None, b"", b"text", binary.STREAM, binary.STREAM + binary.TEXT_MARK, stream("abc", b"\x99"), stream("abc", b"\x7f"), stream("abc", b"\x00")):
        assert binary.stream_text(bad) == ""


def test_tables_of_bodies(spark):
    rows = spark.createDataFrame([(1, gzip.compress(note("a\nb", (3, style(100))))), (2, None), (3, b"zzz")], "id long, body binary")
    assert {tuple(r) for r in binary.decoded_notes(rows, "id", "body").collect()} == {(1, "decoded", "- a\n- b"), (2, "missing", None), (3, "unsupported", None)}
    assert {tuple(r) for r in binary.decoded_messages(spark.createDataFrame([(1, stream("hi")), (2, None)], "id long, body binary"), "id", "body").collect()} == {(1, "hi"), (2, "")}
    assert binary.decoded_notes(rows.where("false"), "id", "body").count() == 0
