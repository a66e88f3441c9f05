"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned by the base
patterns and searched for what is encoded in it: percent escapes, backslash
escapes, UTF-16, base64, and compressed streams. All of these, and all that the patterns
find, are runs of single bytes, so a layer is bytes: of the text itself, one a
character (a question mark for those beyond Latin-1), or of what was decoded. Escapes
are decoded in place, so that their surroundings stay around them; a base64 run, folded
into lines of any one width or not, is decoded at each of the four places at which its
groups may begin, since letters in front of a payload look like part of it; gzip, zlib,
bzip2, xz and lzma streams are looked for at every byte. A layer knows for each of its bytes the span of
the original text it came from, worked out when a finding asks. Layers seen before are not taken again, so cycles
end, and the worklist runs until nothing new decodes.

Nothing is cut at a size: what grows beyond PART lies in a temporary file that goes with
the task, zeros as holes, and is searched there as a whole. Every pass takes time in
proportion to the layer. One map, no shuffle.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_HINT = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
ESCAPE = re.compile(rb"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
#: The same where the escape character is escaped itself any number of times: taken at once from DEEP layers on.
DEEP = 16
DEEP_PERCENT = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
DEEP_ESCAPE = re.compile(rb"\\(?:u005[Cc]|x5[Cc])*(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
#: What may stand around an escape in a finding or in something encoded.
PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{4,}")
WIDE = [(re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){6,}"), 0), (re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){6,}"), 1)]
#: For bytes.translate: zero as 0, printed as p.
KIND = bytes(48 if c == 0 else 112 if 32 <= c < 127 or c in (9, 10, 13) else 32 for c in range(256))
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINE = re.compile(rb"[\t\x20]*([A-Za-z0-9+/_-]+)(={0,2})[\t\x20\r]*")
FOLDED = re.compile(rb"[A-Za-z0-9+/_-][\t\x20\r]*\n[\t\x20]*[A-Za-z0-9+/_-]")
LETTERS = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-")
#: URL-safe letters as plain ones; what may stand between letters goes.
PLAIN_BASE64, BETWEEN = bytes.maketrans(b"-_", b"+/"), b"\r\n\t ="
#: The two bytes of a zlib header: deflate, any window, a right check value, no dictionary.
ZLIB = b"|".join(b"\\x%02x[%s]" % (cmf, b"".join(b"\\x%02x" % flg for flg in range(256) if (256 * cmf + flg) % 31 == 0 and not flg & 32)) for cmf in range(0x08, 0x80, 0x10))
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x5d\0\0[\0-\xff][\0-\x08]|" + ZLIB, re.DOTALL)
#: Bytes that stay in memory, are fed to and taken from a stream at a time, fed to it at first, and that it must give to be looked at.
PART, FEED, TAKEN, FIRST, LEAST = 1 << 26, 1 << 16, 1 << 22, 1 << 10, 12
#: Memory that an xz or lzma dictionary may take.
LZMA_MEMORY = 1 << 30


def base_spans(data) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = []
    if ASSIGN_HINT.search(data):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end() - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(found)


class Store:
    """Bytes that are added piece by piece: in memory up to PART, then in a temporary file that has no name."""

    def __init__(self) -> None:
        self.held, self.file, self.size = bytearray(), None, 0

    def add(self, piece: bytes) -> None:
        if self.file is None and self.size + len(piece) > PART:
            self.file = tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()
        if self.file is None:
            self.held += piece
        elif piece.count(0) == len(piece):
            self.file.seek(len(piece), 1)
        else:
            self.file.write(piece)
        self.size += len(piece)

    def content(self) -> bytes | mmap.mmap:
        if self.file is None:
            return bytes(self.held)
        self.file.truncate(self.size)
        self.file.flush()
        return mmap.mmap(self.file.fileno(), self.size, access=mmap.ACCESS_READ)


class Layer:
    """Bytes, with the span of the original text behind byte i from start(i) to end(i). one: every byte has the same span."""

    def __init__(self, content, start: Callable[[int], int], end: Callable[[int], int], depth: int, one: bool = False):
        self.content, self.start, self.end, self.depth, self.one = content, start, end, depth, one

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start(a), self.end(b - 1)

    def key(self) -> tuple:
        return blake2b(self.content, digest_size=16).digest(), *self.span(0, len(self.content))

    def within(self, content, first: Callable[[int], int], last: Callable[[int], int]) -> Layer:
        """A layer decoded from this one: its byte i comes from bytes first(i) to last(i) here."""
        if self.one:
            return Layer(content, self.start, self.end, self.depth + 1, True)
        return Layer(content, lambda i: self.start(first(i)), lambda i: self.end(last(i)), self.depth + 1)


def codes_of(data, pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, behind, code) of every escape; a code beyond a byte is a question mark."""
    found = [(m.start(), m.end(), int(m[m.lastindex], 16)) for m in pattern.finditer(data)]
    first, behind, code = np.array(found, np.int64).reshape(-1, 3).T
    return first, behind, np.where(code < 256, code, 63)


def unescaped(layer: Layer, pattern: re.Pattern) -> Iterator[Layer]:
    """The printed stretches of a layer that hold escapes, with these decoded in place; stretches are parted by the byte behind each."""
    data, store, maps = layer.content, Store(), []
    for at, until in pieces(data, pattern):
        part = data[at:until]
        first, behind, code = codes_of(part, pattern)
        if not len(first):
            continue
        near = np.zeros(len(part) + 1, np.int8)
        spans = np.array([m.span() for m in PRINTED.finditer(part)], np.int64).reshape(-1, 2)
        held = spans[np.searchsorted(first, spans[:, 0]) < np.searchsorted(first, spans[:, 1])]
        np.add.at(near, held[:, 0], 1)
        np.add.at(near, np.minimum(held[:, 1] + 1, len(part)), -1)
        inside = np.zeros(len(part) + 1, np.int8)
        np.add.at(inside, first + 1, 1)
        np.add.at(inside, behind, -1)
        keep = (np.cumsum(near[:-1], dtype=np.int8) > 0) & (np.cumsum(inside[:-1], dtype=np.int8) == 0)
        out = np.frombuffer(part, np.uint8).copy()
        out[first] = code
        store.add(out[keep].tobytes())
        if layer.one:
            continue
        places = np.flatnonzero(keep)
        ends = places.copy()
        mine = np.searchsorted(places, first)
        right = mine < len(places)
        right[right] &= places[mine[right]] == first[right]
        ends[mine[right]] = behind[right] - 1
        maps.append((places + at, ends + at))
    if not store.size:
        return
    if layer.one:
        yield layer.within(store.content(), int, int)
    else:
        places, ends = (np.concatenate(x) for x in zip(*maps, strict=True))
        yield layer.within(store.content(), lambda i: int(places[i]), lambda i: int(ends[i]))


def pieces(data, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The whole of what is in memory; parts of what lies in a file, never cut within an escape."""
    if not isinstance(data, mmap.mmap):
        yield 0, len(data)
        return
    at = 0
    while at < len(data):
        until = min(at + PART, len(data))
        if until < len(data):
            mark = max(data.rfind(b"%", until - 64, until), data.rfind(b"\\", until - 64, until))
            while mark > at and (m := pattern.match(data, mark)) and m.end() > until:
                until = m.end()
        yield at, until
        at = until


def stretched(layer: Layer, pattern: re.Pattern, offset: int) -> Iterator[Layer]:
    """The letters of UTF-16 stretches, with a zero between stretches."""
    spans = [m.span() for m in pattern.finditer(layer.content)]
    if not spans:
        return
    store, begins, at = Store(), [], 0
    for a, b in spans:
        begins.append(at)
        store.add(layer.content[a + offset : b : 2] + b"\0")
        at += (b - a) // 2 + 1
    place = lambda i: min(spans[k := bisect_right(begins, i) - 1][0] + 2 * (i - begins[k]), spans[k][1] - 2)
    yield layer.within(store.content(), place, lambda i: place(i) + 1)


def base64_runs(data) -> Iterator[tuple[int, int, list[tuple[int, int, int]] | None]]:
    """(first, behind, lines) of runs of base64 letters; lines of one width that are nothing else are one run, with the letters that end the line before and begin the line behind: (letters before, place of the first, letters) each."""
    yield from ((*m.span(), None) for m in BASE64.finditer(data))
    at = 0
    while m := FOLDED.search(data, at):
        end = data.find(b"\n", m.start())
        head = data[data.rfind(b"\n", 0, end) + 1 : end].rstrip(b"\t\r ")
        letters = len(head) - len(head.rstrip(LETTERS))
        behind = data.rfind(b"\n", 0, end) + 1 + len(head)
        lines, width, at = [(0, behind - letters, letters)], 0, end + 1
        while at < len(data) and (line := BASE64_LINE.match(data, at)) and ((size := line.end(1) - line.start(1)) <= width or not width):
            lines.append((letters, line.start(1), size))
            width, letters, behind, at = width or size, letters + size, line.end(2), line.end()
            if data[at : at + 1] != b"\n" or size < width or line[2]:
                break
            at += 1
        if letters >= 16:
            yield lines[0][1], behind, lines
        at = max(at - 1, m.end() - 1)


def base64(layer: Layer, a: int, b: int, lines) -> Iterator[Layer]:
    """Bytes of a base64 run, plain or URL-safe, padded or not, with its groups of four beginning at each of the first four letters."""
    befores = [x[0] for x in lines or ()]

    def letter(k: int) -> int:
        if not lines:
            return a + k
        before, place, _ = lines[bisect_right(befores, k) - 1]
        return place + k - before

    total = sum(x[2] for x in lines) if lines else len(layer.content[max(a, b - 2) : b].rstrip(b"=")) + max(a, b - 2) - a
    for skip in range(4):
        store, rest = Store(), b""
        for at in range(a if skip == 0 or lines else a + skip, b, TAKEN):
            rest += layer.content[at : min(at + TAKEN, b)].translate(PLAIN_BASE64, BETWEEN)
            if lines and at == a:
                rest = rest[skip:]
            whole = len(rest) // 4 * 4
            store.add(binascii.a2b_base64(rest[:whole]))
            rest = rest[whole:]
        if len(rest) > 1:
            store.add(binascii.a2b_base64(rest + b"=" * (4 - len(rest))))
        if store.size < 6:
            return
        first = lambda i, skip=skip: letter(skip + 8 * i // 6)
        last = lambda i, skip=skip: letter(min(skip + (8 * i + 7) // 6, total - 1))
        made = layer.within(store.content(), first, last)
        made.padded = layer.end(b - 1)
        yield made


def grown(stream, piece: bytes) -> Iterator[bytes]:
    """What a piece of a compressed stream grows to, TAKEN bytes at most at a time."""
    while True:
        out = stream.decompress(piece, TAKEN)
        yield out
        if stream.eof or len(out) < TAKEN:
            return
        piece = getattr(stream, "unconsumed_tail", b"")


def opened(data, at: int):
    head = data[at : at + 6]
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\0" or head[:3] == b"\x5d\0\0":
        return lzma.LZMADecompressor(memlimit=LZMA_MEMORY)
    return zlib.decompressobj(47)


def printed(data) -> bool:
    """Whether the first bytes look like text: nine in ten printed, and of eight kinds."""
    head = data[:4096]
    return len(set(head)) >= 8 and 10 * sum(len(m[0]) for m in PRINTED.finditer(head)) >= 9 * len(head)


def inflated(data, at: int) -> tuple[Store, int, bool]:
    """The content of a stream and of the members that follow it, as far as it is sound; the place behind it, -1 where it breaks off; and whether it is one.

    Two bytes that look like a zlib header are often none. A stream that breaks
    off within its first FIRST bytes counts if it began with a longer mark or what it gave looks like text.
    """
    store, begin, real = Store(), at, not (data[at] & 15 == 8 and data[at] < 0x80)
    while True:
        sound = True
        try:
            stream = opened(data, at)
            while not stream.eof and at < len(data):
                piece = data[at : at + (FIRST if at == begin else FEED)]
                at += len(piece)
                for out in grown(stream, piece):
                    store.add(out)
        except (zlib.error, lzma.LZMAError, OSError, ValueError, EOFError):
            sound = False
        real = real or sound or at - begin > FIRST
        if not sound or not stream.eof:
            break
        at -= len(stream.unused_data)
        while at < len(data) and not data[at]:  # members may be padded
            at += 1
        if not STREAM.match(data, at):
            break
    return store, at if sound else -1, real


def streams(layer: Layer) -> Iterator[Layer]:
    """The content of each compressed stream in a layer; its span runs from the stream's first byte to the end of the encoded run."""
    data, at = layer.content, 0
    while m := STREAM.search(data, at):
        store, behind, real = inflated(data, m.start())
        at = max(behind, m.start() + 1)
        if store.size >= LEAST and (real or printed(store.content())):
            a, b = layer.span(m.start(), len(data))
            b = max(b, getattr(layer, "padded", 0))
            yield Layer(store.content(), lambda _, a=a: a, lambda _, b=b: b, layer.depth + 1, True)


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """What a layer holds, one step further decoded."""
    data, deep = layer.content, layer.depth > DEEP
    if layer.depth:
        yield from streams(layer)
        pairs = data.translate(KIND) if isinstance(data, bytes) else None
        for (pattern, offset), mark in zip(WIDE, (b"p0" * 6, b"0p" * 6), strict=True):
            if pairs is None or mark in pairs:
                yield from stretched(layer, pattern, offset)
    if PERCENT.search(data):
        yield from unescaped(layer, DEEP_PERCENT if deep else PERCENT)
    if ESCAPE.search(data):
        yield from unescaped(layer, DEEP_ESCAPE if deep else ESCAPE)
    for run in base64_runs(data):
        yield from base64(layer, *run)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, kind, end) by start, then kind. One way through the layers is held at a time."""
    root = Layer(text.encode("latin-1", "replace"), int, lambda i: i + 1, 0)
    base = base_spans(root.content)
    found, seen, path = set(base), set(), [inner_layers(root)]
    while path:
        inner = next(path[-1], None)
        if inner is None:
            path.pop()
        elif inner.content and (key := inner.key()) not in seen:
            seen.add(key)
            for a, kind, b in base_spans(inner.content):
                start, end = inner.span(a, b)
                found.add((start, kind, end))
            path.append(inner_layers(inner))
    return base, sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) of every row.

    The counts and base_spans are those of the text itself; spans adds what
    decoded layers hold, as spans of the text; all are kind:start:end, code
    points, end exclusive, by start, then kind, comma-joined. Compressed streams
    are followed to their end, so time, and beyond 64 MiB a temporary file, follow
    what they grow to; a finding in one has the span of its
    encoded run. Null and empty texts have no span. Repeated rows and null ids each return their
    row; other columns are not read; an empty table returns none.
    """

    def row(text: str) -> tuple[int, int, int, str, str]:
        base, every = scan(text)
        return *(sum(k == kind for _, k, _ in base) for kind in range(3)), written(base), written(every)

    return map_texts(id_and_text(docs, id_col, text_col), row, "n_assign long, n_access long, n_hex long, base_spans string, spans string", [pa.int64()] * 3 + [pa.string()] * 2)
