"""Secret scan with a recursive decoding worklist.

Every text is scanned as it is; then URL escapes, Unicode escapes and wide characters, hex and base64 runs, and compressed payloads
are unwrapped into new layers, each scanned and unwrapped in turn until no new layer appears. A layer keeps, for each of its
characters, the span of the original text it came from, so that what is found inside maps back; all that compressed data holds maps
to that data's span. Layers already seen are not entered again (a compressed file may unpack to itself).

Compressed data may hold far more than memory does. Beyond BLOCK bytes it is a stream: scanned in windows of BLOCK that overlap
by OVERLAP, and read again from its start for a piece that does not end in its window (a base64 run, a compressed member), which is
a stream of its own. So memory is bounded and nothing is cut off; time follows what is unpacked. What can't be read in bounded
memory, a zstandard frame or xz stream that asks for a window of more than WINDOW bytes, is counted as unread.

Null or empty texts have no spans; very long texts are scanned whole; ties of start are ordered by kind, then end; repeated rows give
repeated rows; an empty table gives an empty result; extra columns are ignored, whatever their names, and only the id is carried.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, string_column, texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|\\([0-3][0-7]{2})|&#([0-9]{1,7});")
#: Characters of two or four bytes, read as single ones.
WIDE = re.compile(r"(?:[^\0]\0{3}){8,}|(?:[^\0]\0){8,}")
DIGITS = re.compile(r"[0-9A-Fa-f]{32,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\t ]*+[A-Za-z0-9+/_-]++)++={0,2}")
STANDARD = str.maketrans("-_", "+/")
#: What compressed data starts with: gzip, bzip2, xz, zstandard, zlib.
STARTS = ("\x1f\x8b", "BZh", "\xfd7zXZ\0", "\x28\xb5\x2f\xfd", "x\x01", "x^", "x\x9c", "x\xda")
MAGIC = re.compile("|".join(map(re.escape, STARTS)))
NARROW = re.compile(r"[\x00-\xff]+")
SPACES = re.compile("\x20{2,}")
#: Bytes of unpacked data in one layer, or one window of a stream; those that two windows share; bytes that one step may unpack.
BLOCK, OVERLAP, STEP = 8 << 20, 1 << 20, 1 << 20
#: The largest window that a compressed frame may ask for, as the tools allow by default; xz needs a little more than its own.
WINDOW = 1 << 27


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules, leftmost and not overlapping within a kind.

    ACCESS and HEX state their least length in the pattern: a shorter run can hold no other match, so the matches are the same.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and where it is from: for each character a span of the original text, one span for all, or (None) itself."""

    __slots__ = ("begin", "end", "span", "text")

    def __init__(self, text: str, begin: array | None = None, end: array | None = None, span: tuple[int, int] | None = None):
        self.text, self.begin, self.end, self.span = text, begin, end, span

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.span:
            return self.span
        return (start, end) if self.begin is None else (min(self.begin[start:end]), max(self.end[start:end]))

    def ends(self) -> tuple[int, int]:
        """Where its first and last characters are from."""
        return self.span or (self.begin[0], self.end[-1])


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """pieces: (start, end, decoded, for each decoded character its span in the layer's text)."""
    out, begin, end, at = [], array("q"), array("q"), 0
    if layer.span:
        for start, stop, decoded, _ in pieces:
            out += [layer.text[at:start], decoded]
            at = stop
        return Layer("".join([*out, layer.text[at:]]), span=layer.span)

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        begin.extend(range(a, b) if layer.begin is None else layer.begin[a:b])
        end.extend(range(a + 1, b + 1) if layer.end is None else layer.end[a:b])

    for start, stop, decoded, spans in pieces:
        keep(at, start)
        out.append(decoded)
        for a, b in spans:
            x, y = layer.origin(a, b)
            begin.append(x)
            end.append(y)
        at = stop
    keep(at, len(layer.text))
    return Layer("".join(out), begin, end)


def _from_url(layer: Layer) -> list[Layer]:
    """With each run of escapes as UTF-8 where it is valid; and, if that joins bytes, with each byte as a character of its own."""
    pieces, narrow, joined = [], [], False
    for m in URL.finditer(layer.text):
        raw, at, spans = bytes.fromhex(m[0].replace("%", "")), m.start(), []
        single = (m.start(), m.end(), raw.decode("latin-1"), [(at + 3 * i, at + 3 * i + 3) for i in range(len(raw))])
        narrow.append(single)
        try:
            decoded = raw.decode()
        except UnicodeDecodeError:
            pieces.append(single)
            continue
        joined |= len(decoded) < len(raw)
        for c in decoded:
            n = 3 * len(c.encode())
            spans.append((at, at + n))
            at += n
        pieces.append((m.start(), m.end(), decoded, spans))
    return [_replaced(layer, p) for p in ([pieces, narrow] if joined else [pieces] if pieces else [])]


def _from_escapes(layer: Layer) -> Layer | None:
    pieces, high = [], None
    for m in ESCAPE.finditer(layer.text):
        code = int(m[8]) if m[8] else int(m[7], 8) if m[7] else int(next(g for g in m.groups() if g), 16)
        if 0xDC00 <= code < 0xE000 and high and high[1] == m.start():
            code, start = 0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00, high[0]
        else:
            start = m.start()
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((start, m.end(), chr(code), [(start, m.end())]))
    return _replaced(layer, pieces) if pieces else None


def _from_wide(layer: Layer) -> Layer | None:
    """Without the zero bytes of UTF-16 or UTF-32 that has been read as single bytes, either end first."""
    pieces = [(m.start() + z.start(), m.start() + z.end(), "", []) for m in WIDE.finditer(layer.text) for z in re.finditer("\0+", m[0])]
    return _replaced(layer, pieces) if pieces else None


def _from_hex(layer: Layer) -> list[Layer]:
    """Runs of digits, at both alignments."""
    out = []
    for m in DIGITS.finditer(layer.text):
        for a in (m.start(), m.start() + 1):
            n = (m.end() - a) // 2
            text = bytes.fromhex(layer.text[a : a + 2 * n]).decode("latin-1")
            if layer.span:
                out.append(Layer(text, span=layer.span))
            else:
                both = [layer.origin(a + 2 * k, a + 2 * k + 2) for k in range(n)]
                out.append(Layer(text, array("q", [x for x, _ in both]), array("q", [y for _, y in both])))
    return out


class _Inflate:
    needs_input = True

    def __init__(self, bits: int):
        self.d = zlib.decompressobj(bits)

    def step(self, raw: bytes) -> tuple[bytes, bytes]:
        """(output, input not used)."""
        out = self.d.decompress(raw, STEP)
        return out, self.d.unused_data if self.d.eof else self.d.unconsumed_tail

    def end(self) -> bytes:
        return self.d.flush()


class _Buffered:
    """bzip2 and xz, which keep what they don't use at once."""

    def __init__(self, d: bz2.BZ2Decompressor | lzma.LZMADecompressor):
        self.d = d

    @property
    def needs_input(self) -> bool:
        return self.d.needs_input

    def step(self, raw: bytes) -> tuple[bytes, bytes]:
        out = self.d.decompress(raw, STEP)
        return out, self.d.unused_data if self.d.eof else b""

    def end(self) -> bytes:
        return b""


class _Zstandard(_Buffered):
    needs_input = True

    def step(self, raw: bytes) -> tuple[bytes, bytes]:
        out = self.d.decompress(raw[:256])  # in small steps: a few bytes may hold megabytes
        return out, self.d.unused_data + raw[256:] if self.d.eof else raw[256:]


def _decoder(head: bytes) -> _Inflate | _Buffered | None:
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return _Zstandard(zstandard.ZstdDecompressor(max_window_size=WINDOW).decompressobj())
    if head[:2] == b"\x1f\x8b":
        return _Inflate(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return _Inflate(15)
    if head[:3] == b"BZh":
        return _Buffered(bz2.BZ2Decompressor())
    if head[:6] == b"\xfd7zXZ\0":
        return _Buffered(lzma.LZMADecompressor(memlimit=WINDOW + (16 << 20)))
    return None


def sliced(raw: bytes | memoryview, n: int = 1 << 16) -> Iterator[bytes]:
    return (bytes(raw[i : i + n]) for i in range(0, len(raw), n))


class Unpacked:
    """What gzip, zlib, bzip2, xz or zstandard data at the start of chunks holds, member after member, in steps.

    taken is the end of the last member that did not fail; whole says that it ended, refused that its window is too large.
    """

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.fed, self.taken, self.whole, self.refused = iter(chunks), 0, 0, True, False

    def _more(self) -> bytes:
        x = next(self.chunks, b"")
        self.fed += len(x)
        return x

    def __iter__(self) -> Iterator[bytes]:
        held = b""
        while True:
            while len(held) < 6 and (more := self._more()):
                held += more
            if (d := _decoder(held[:6])) is None:
                return
            try:
                while not d.d.eof:
                    if not held and d.needs_input and not (held := self._more()):
                        self.whole, self.taken = False, self.fed
                        yield d.end()
                        return
                    out, held = d.step(held)
                    if out:
                        yield out
            except Exception as e:  # each of the libraries has errors of its own; bad data is no layer
                if isinstance(e, MemoryError) and "limit" not in str(e):
                    raise
                self.refused = "emory" in str(e)
                return
            self.taken = self.fed - len(held)


class Stream:
    """Bytes that can be read again from their start, all from one span of the text."""

    def __init__(self, chunks: Callable[[], Iterable[bytes]], span: tuple[int, int]):
        self.chunks, self.span = chunks, span

    def rest(self, offset: int) -> Iterator[bytes]:
        for x in self.chunks():
            if offset < len(x):
                yield x[offset:]
            offset = max(0, offset - len(x))

    def run(self, offset: int, shift: int, wrapped: bool) -> Iterator[bytes]:
        """The base64 run that starts at offset, decoded from its character shift on."""
        allowed = re.compile(r"[A-Za-z0-9+/_\r\n\t\x20-]*" if wrapped else r"[A-Za-z0-9+/_-]*")
        held = ""
        for x in self.rest(offset):
            text = x.decode("latin-1")
            part = allowed.match(text)[0]
            held += "".join(part.split()).translate(STANDARD)
            shift, held = max(0, shift - len(held)), held[shift:]
            n = len(held) // 4 * 4
            if n:
                yield base64.b64decode(held[:n])
                held = held[n:]
            if len(part) < len(text):
                break
        if len(held) > 1:
            yield base64.b64decode(held + "=" * (-len(held) % 4))


class Search:
    """found: (start, kind index, end); seen: digests of layers; unread: pieces that ask for too large a window."""

    def __init__(self, text: str):
        self.base = scan(text)
        self.found, self.unread, self.pieces = set(self.base), 0, set()
        self.seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
        self.enter(self.unwrap(Layer(text)))

    def new(self, layer: Layer) -> bool:
        raw = layer.text.encode("utf-8", "surrogatepass")
        key = hashlib.sha256(repr(layer.text and layer.ends()).encode() + raw).digest()
        if key in self.seen or hashlib.sha256(raw).digest() in self.seen:
            return False
        self.seen.add(key)
        return True

    def enter(self, work: list[Layer | Stream]) -> None:
        while work:
            layer = work.pop()
            if isinstance(layer, Stream):
                self.windows(layer)
            elif self.new(layer):
                for start, kind, end in scan(layer.text):
                    x, y = layer.origin(start, end)
                    self.found.add((x, kind, y))
                work += self.unwrap(layer)

    def windows(self, stream: Stream) -> None:
        """Each window with what it shares with the one before; what is inside one is searched before the next is read."""
        chunks, at, tail, narrow = iter(stream.chunks()), 0, "", ""
        more = True
        while more:
            parts, size = [], 0
            while size < BLOCK and (x := next(chunks, b"")):
                parts.append(x)
                size += len(x)
            more = size >= BLOCK
            text = b"".join(parts).decode("latin-1")
            # blanks inside an assignment may be longer than any window
            narrow = SPACES.sub("\x20", narrow + text)
            if self.first(stream.span, hashlib.sha256(narrow.encode()).digest(), "scan"):
                self.found.update((stream.span[0], kind, stream.span[1]) for _, kind, _ in scan(narrow))
            narrow = narrow[-OVERLAP:]
            layer = Layer(tail + text, span=stream.span)
            if self.new(layer):
                self.enter(self.unwrap(layer, (stream, at - len(tail)) if more else None, bool(tail)))
            at += size
            tail = layer.text[-OVERLAP:]

    def unpack(self, raw: bytes | memoryview, span: tuple[int, int], beyond: tuple[Stream, int] | None = None) -> tuple[list[Layer | Stream], int]:
        """(layers of what compressed data at the start of raw holds, bytes it takes there); beyond: where raw lies in a stream that goes on."""
        inner, parts, size = Unpacked(sliced(raw)), [], 0
        for x in inner:
            size += len(x)
            if size >= BLOCK:
                parts = []
                if beyond:
                    break
            else:
                parts.append(x)
        self.unread += inner.refused
        if size < BLOCK and (inner.whole or not beyond or not size):
            return ([Layer(b"".join(parts).decode("latin-1"), span=span)] if size else []), inner.taken
        if not beyond:
            held = bytes(raw[: inner.taken or None])
            return [Stream(lambda: Unpacked(sliced(held)), span)], inner.taken
        stream, at = beyond
        return ([Stream(lambda: Unpacked(stream.rest(at)), span)] if self.first(stream, at, "packed") else []), 1

    def first(self, *what: object) -> bool:
        """Whether a piece or window is new: what windows share is seen twice."""
        known = what in self.pieces
        self.pieces.add(what)
        return not known

    def from_base64(self, layer: Layer, beyond: tuple[Stream, int] | None, inside: bool) -> list[Layer | Stream]:
        """Every run, and runs joined over line breaks, at the four alignments: wherever in a run its base64 starts, one of them has it.

        All decoded bytes stay, as characters below 256, so text beside other bytes is found.
        """
        out = []
        for m in itertools.chain(BASE64.finditer(layer.text), WRAPPED.finditer(layer.text)):
            run = m[0].rstrip("=")
            if beyond and m.end() == len(layer.text):  # it may go on: read by itself, unless it began before this window
                stream, at, wrapped = beyond[0], beyond[1] + m.start(), "\n" in run
                if not (inside and m.start() == 0) and self.first(stream, at, "wrapped" if wrapped else "run"):
                    out += [Stream(lambda at=at, s=s, wrapped=wrapped: stream.run(at, s, wrapped), layer.span) for s in range(4)]
                continue
            places = [m.start() + k for k, c in enumerate(run) if c not in "\r\n\t "] if "\n" in run else range(m.start(), m.start() + len(run))
            if len(places) < 16:
                continue
            body = "".join(run.split()).translate(STANDARD)
            for shift in range(4):
                part = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
                raw = base64.b64decode(part + "=" * (-len(part) % 4))
                if not shift:
                    inner, taken = self.unpack(raw, layer.origin(m.start(), m.end()))
                    out += inner
                    if taken == len(raw):
                        continue
                text = raw.decode("latin-1")
                if layer.span:
                    out.append(Layer(text, span=layer.span))
                    continue
                begin, end = array("q"), array("q")
                for at in range(len(text)):
                    a = places[shift + at * 8 // 6]
                    b = places[min(len(places), shift + ((at + 1) * 8 + 5) // 6) - 1] + 1
                    x, y = layer.origin(a, b)
                    begin.append(x)
                    end.append(y)
                out.append(Layer(text, begin, end))
        return out

    def from_packed(self, layer: Layer, beyond: tuple[Stream, int] | None) -> list[Layer | Stream]:
        """Every piece of compressed bytes that stands in the text as characters below 256."""
        out = []
        if not any(x in layer.text for x in STARTS):
            return out
        for run in NARROW.finditer(layer.text):
            raw, at = memoryview(run[0].encode("latin-1")), 0
            while m := MAGIC.search(run[0], at):
                begin = run.start() + m.start()
                goes_on = (beyond[0], beyond[1] + begin) if beyond and run.end() == len(layer.text) else None
                inner, taken = self.unpack(raw[m.start() :], layer.span or (0, 0), goes_on)
                at = m.start() + max(taken, 1)
                for x in inner:
                    x.span = layer.origin(begin, run.start() + at)
                out += inner
        return out

    def unwrap(self, layer: Layer, beyond: tuple[Stream, int] | None = None, inside: bool = False) -> list[Layer | Stream]:
        """The layers inside. beyond: where the layer, a window, lies in a stream that goes on; inside: it has an end of the window before."""
        text, out = layer.text, []
        if "%" in text:
            out += _from_url(layer)
        if "\\" in text or "&#" in text or "%u" in text:
            out.append(_from_escapes(layer))
        if "\0" in text:
            out.append(_from_wide(layer))
        out += _from_hex(layer)
        out += self.from_base64(layer, beyond, inside)
        out += self.from_packed(layer, beyond)
        return [x for x in out if x is not None]


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind index, end) in order; ends exclusive, in code points of the text."""
    found = Search(text)
    return found.base, sorted(found.found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct>, spans array<struct>, unread) per row; one pass over each text, no shuffle."""
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    id_type = df.schema[id_col].dataType.simpleString()
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [Search(x) for x in texts(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([told(x.base) for x in found], inner), pa.array([told(sorted(x.found)) for x in found], inner), pa.array([x.unread for x in found], pa.int64())], ["id", "base", "spans", "unread"])

    return map_arrow(df.select(df[id_col].alias("id"), string_column(df, text_col).alias("text")), run, f"id {id_type}, base {kind}, spans {kind}, unread bigint").withColumnRenamed("id", id_col)


def redact(text: str) -> str:
    """The text with every span found replaced by its kind in brackets; overlapping spans merge."""
    _, spans = find_secrets(text)
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])
