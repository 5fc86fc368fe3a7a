"""Secret scan with a worklist of decoded layers.

The text is the first layer. Every layer is scanned for the three base kinds; then percent
escapes, character escapes, base64 runs and compressed bytes in it are unwrapped into further
layers, each with a map from its characters to places of the text, until no layer is new. A
layer that has come from the same place before ends a cycle. Bytes that aren't UTF-8 are read as
Latin-1, so binary layers are scanned like others; in a run of percent escapes the bytes that
aren't UTF-8 stay escapes. Percent signs that are escaped several times are unwrapped at once. A base64 run may
go over line ends, and may begin anywhere in a longer run of its letters, as in a URL's path: it is
read from each of its first four characters, and compressed bytes are looked for at every place
of what that gives. Runs under 16 characters hold no secret, as the shortest has 12 bytes. Members of
compressed bytes that follow one another are one layer; what looks like a header inside a whole member is
that member's content and isn't tried. Of a cut or damaged stream a layer has what it gives. Many places of
ordinary bytes look like headers, so what such streams read and give is counted: once it is over BROKEN times
the bytes of the sound layers (and FREE), a place that a broken stream of its kind of mark (zlib's, or another) has already gone over waits until all
else is done, and is tried then: nothing is passed by, and of a text without such places the time follows the bytes. Decompressed bytes beyond MAX_LAYER are scanned in overlapping pieces and
counted in n_refused, since what is encoded across the end of a piece can be missed there; text
itself is scanned whole at any length.

Defined results: null counts as empty; spans are code points of the text, end exclusive; what a
layer shows inside an encoded run is reported as the whole run; equal spans are one; rows that repeat
an id or a text are each scanned; a null id stays null; texts of any length are scanned whole; an
empty table gives no rows; other columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed kinds, in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
#: Bytes that two pieces of a larger layer share, that a decompressor gives at once, and that it is fed.
OVERLAP, STEP, FEED = 1 << 20, 1 << 20, 1 << 10
#: What broken streams may read and give for each byte of sound layers, and besides, before places that they went over wait.
BROKEN, FREE = 8, 1 << 20
#: The shortest secret of any kind.
SHORTEST = 12
REDACTED = "[REDACTED]"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile("(" + "|".join(map(either_case, _WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy runs under 20 characters are dropped
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Escapes of percent signs, twice or more; of backslashes and ampersands likewise.
_NESTED = re.compile(r"%25(?:25)+")
_NESTED_ESCAPES = ((re.compile(r"\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC]){2,}"), "\\"), (re.compile(r"&(?:#0{0,5}38;|#[xX]0{0,4}26;){2,}"), "&"))
#: The two alphabets: the first line of a run, and a line that goes on.
_BASE64 = tuple((re.compile(f"{c}{{16,}}={{0,2}}"), re.compile(f"\\r?\\n[ \\t]*({c}+={{0,2}})")) for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]"))
_LINE_ENDS = re.compile(r"\s+")
#: Marks that ordinary bytes hardly have (gzip, bzip2, xz), and those of zlib, one of which is "x^".
_MARKS = (re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00"), re.compile(rb"\x78[\x01\x5e\x9c\xda]"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """Decoded text; pieces of it stand for spans of the original text."""

    __slots__ = ("cuts", "places", "text", "whole")

    def __init__(self, text: str, whole: tuple[int, int] | None = None, cuts: list[int] | None = None, places: list | None = None):
        # whole: all of it stands for one span; else cuts[i] begins a piece with places[i] = (start, end or None for one to one)
        self.text, self.whole, self.cuts, self.places = text, whole, cuts or [0], places or [(0, None)]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        piece = bisect_right(self.cuts, i) - 1
        start, end = self.places[piece]
        return (start, end) if end is not None else (start + i - self.cuts[piece], start + i - self.cuts[piece] + 1)

    def rewritten(self, runs: list[tuple[int, int, str]]) -> Layer:
        """This layer with some runs replaced by what they decode to."""
        out, cuts, places, at, size = [], [], [], 0, 0

        def put(text: str, piece: list[tuple[int, tuple]]) -> None:
            nonlocal size
            for offset, place in piece:
                cuts.append(size + offset)
                places.append(place)
            out.append(text)
            size += len(text)

        def same(a: int, b: int) -> list[tuple[int, tuple]]:
            if self.whole:
                return [(0, self.whole)]
            first = bisect_right(self.cuts, a) - 1
            got = []
            for k in range(first, bisect_right(self.cuts, b - 1)):
                start, end = self.places[k]
                c = max(self.cuts[k], a)
                got.append((c - a, (start, end) if end is not None else (start + c - self.cuts[k], None)))
            return got

        for a, b, text in runs:
            if a > at:
                put(self.text[at:a], same(at, a))
            if text:
                put(text, [(0, self.origin(a, b))])
            at = b
        if at < len(self.text):
            put(self.text[at:], same(at, len(self.text)))
        return Layer("".join(out), self.whole, cuts, places)


def _kept_percent(error: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(f"%{b:02X}" for b in error.object[error.start : error.end]), error.end


codecs.register_error("docweave.percent", _kept_percent)


def percent_decoded(run: str) -> str | None:
    """The run with its UTF-8 decoded and other bytes left as escapes; None if there are only such."""
    out = bytes.fromhex(run.replace("%", "")).decode("utf-8", "docweave.percent")
    return out if len(out) < len(run) else None


def unescaped(run: str) -> str | None:
    try:
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if run.startswith("\\u"):
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
        if run.startswith("\\U"):
            return chr(int(run[2:], 16))
        if run.startswith("\\x"):
            raw = bytes.fromhex(run.replace("\\x", ""))
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
    except (ValueError, OverflowError):
        return None


def base64_decoded(run: str) -> Iterator[bytes]:
    """The bytes of a run that is read from each of its first four characters, as far as whole groups of letters go."""
    body = _LINE_ENDS.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        some = body[skip:]
        some = some[:-1] if len(some) % 4 == 1 else some
        if len(some) >= 16:
            yield base64.b64decode(some + "=" * (-len(some) % 4))


def base64_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of base64 letters. A run goes on over a line end while lines have the width of its second; a shorter one, of whole groups, ends it."""
    for number, (first, more) in enumerate(_BASE64):
        at = 0
        while m := first.search(text, at):
            end, width = m.end(), 0
            while text[end - 1] != "=" and (line := more.match(text, end)):
                size = line.end() - line.start(1)
                width = width or size
                if size > width or (size < width or width < 16) and size % 4:
                    break
                end = line.end()
                if size < width:
                    break
            if not number or "-" in (run := text[m.start() : end]) or "_" in run:  # else it's in a run of the first alphabet
                yield m.start(), end
            at = end


def percent_runs(text: str) -> list[tuple[int, int, str]]:
    """The runs of percent escapes that decode to something; escapes of escapes go to one escape in a step of their own."""
    if nested := [(m.start(), m.end(), "%25") for m in _NESTED.finditer(text)]:
        return nested
    return [(m.start(), m.end(), got) for m in _PERCENT.finditer(text) if (got := percent_decoded(m.group())) is not None]


def escaped_runs(text: str) -> list[tuple[int, int, str]]:
    """The same for character escapes."""
    if nested := sorted((m.start(), m.end(), to) for pattern, to in _NESTED_ESCAPES for m in pattern.finditer(text)):
        return nested
    return [(m.start(), m.end(), got) for m in _ESCAPE.finditer(text) if (got := unescaped(m.group())) is not None]


def _opened(raw: bytes):
    """A decompressor for gzip, zlib, bzip2 or xz bytes, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class Stream:
    """The members that begin at a place of some bytes and follow one another, without a copy of the rest."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at
        self.gave, self.whole = 0, at  # bytes given, and where the last whole member ends

    def parts(self) -> Iterator[bytes]:
        """The content in parts of at most STEP bytes; ends where a stream is cut or damaged."""
        raw = self.raw
        while (maker := _opened(raw[self.at : self.at + 6])) is not None:
            while not maker.eof:
                # small steps, since a stream that turns out damaged loses what the call had given
                step = raw[self.at : self.at + FEED]
                if not step:
                    return
                self.at += len(step)
                while True:
                    try:
                        out = maker.decompress(step, STEP)
                    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                        return
                    if out:
                        self.gave += len(out)
                        yield out
                    step = getattr(maker, "unconsumed_tail", b"")
                    if maker.eof or not (step or (len(out) == STEP if hasattr(maker, "unconsumed_tail") else not maker.needs_input)):
                        break
            self.at -= len(maker.unused_data)
            self.whole = self.at

    def pieces(self) -> Iterator[bytes]:
        """The content in pieces of about MAX_LAYER bytes at most, each beginning with the last OVERLAP of the one before."""
        held, fresh = bytearray(), False
        for part in self.parts():
            for at in range(0, len(part), MAX_LAYER):
                some = part[at : at + MAX_LAYER]
                if fresh and len(held) + len(some) > MAX_LAYER:
                    yield bytes(held)
                    del held[: -min(OVERLAP, MAX_LAYER // 2)]
                held += some
                fresh = True
        if fresh:
            yield bytes(held)


def places(raw: bytes) -> Iterator[tuple[int, int]]:
    """(kind of mark, place) where compressed bytes may begin: the start, if anything there opens, then the plain marks, then those of zlib."""
    if _opened(raw[:6]) is not None:
        yield 0, 0
    for kind, marks in enumerate(_MARKS):
        yield from ((kind, m.start()) for m in marks.finditer(raw) if m.start())


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, all spans, layers, refused layers) of a text; spans are (start, kind, end)."""
    text = text or ""
    base = base_spans(text)
    every = set(base)
    # bytes come with their span and whether they are sound: not out of a broken stream
    work: list[Layer | tuple[bytes, tuple[int, int], bool]] = [Layer(text)]
    # (bytes, span, sound, places) that wait: tried one by one when nothing else is left
    waiting: list[tuple[bytes, tuple[int, int], bool, list[int], list[tuple[int, int]]]] = []
    seen: set[tuple] = set()
    layers = refused = 0
    allowed, spent = FREE, [0, 0]

    def unpack(raw: bytes, whole: tuple[int, int], sound: bool, place: int, members: list[tuple[int, int]]) -> Stream:
        nonlocal layers, refused, every
        stream, amount = Stream(raw, place), 0
        for inner in stream.pieces():
            amount += 1
            if amount > 1:  # a large layer: nothing of it is held but the piece at hand
                _, found, more, less = scan(inner.decode("latin-1"))
                every |= {(whole[0], kind, whole[1]) for _, kind, _ in found}
                layers, refused = layers + more, refused + less
            elif len(inner) >= SHORTEST:
                work.append((inner, whole, sound and stream.whole > place))
        refused += amount > 1
        if stream.whole > place:
            insort(members, (place, stream.whole))
        return stream

    def inside(members: list[tuple[int, int]], raw: bytes, place: int) -> bool:
        before = bisect_right(members, (place, len(raw)))
        return bool(before) and place < members[before - 1][1]

    while work or waiting:
        if not work:
            raw, whole, sound, left, members = waiting[-1]
            place = left.pop()
            if not left:
                waiting.pop()
            if not inside(members, raw, place):
                unpack(raw, whole, sound, place, members)
            continue
        layer = work.pop()
        if isinstance(layer, tuple):
            raw, whole, sound = layer
            key = hashlib.blake2b(raw, digest_size=16).digest(), whole, "bytes"
            if key in seen:
                continue
            seen.add(key)
            allowed += BROKEN * len(raw) * sound
            members: list[tuple[int, int]] = []  # whole ones
            reached = [0, 0]  # the end of what broken streams of a kind of mark went over
            left = []
            for kind, place in places(raw):
                if inside(members, raw, place):
                    continue
                if place < reached[kind] and spent[kind] > allowed:
                    left.append(place)
                    continue
                stream = unpack(raw, whole, sound, place, members)
                if stream.at > stream.whole:
                    spent[kind] += stream.at - stream.whole + stream.gave
                    reached[kind] = max(reached[kind], stream.at)
            if left:
                waiting.append((raw, whole, sound, left[::-1], members))
            try:
                plain = raw.decode()
            except UnicodeDecodeError:
                plain = raw.decode("latin-1")
            work.append(Layer(plain, whole))
            continue
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.whole
        if key in seen or not layer.text:
            continue
        seen.add(key)
        layers += 1
        if layers > 1:
            every |= {(a, kind, b) for start, kind, end in base_spans(layer.text) for a, b in [layer.origin(start, end)]}
        if "%" in layer.text and (runs := percent_runs(layer.text)):
            work.append(layer.rewritten(runs))
        if ("\\" in layer.text or "&#" in layer.text) and (runs := escaped_runs(layer.text)):
            work.append(layer.rewritten(runs))
        for start, end in base64_runs(layer.text):
            whole = layer.origin(start, end)
            work += [(raw, whole, True) for raw in base64_decoded(layer.text[start:end])]
    return base, sorted(every), layers, refused


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or union of spans that overlap, replaced."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, all spans, layers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(kind == k for _, kind, _ in base) for base, _, _, _ in found] for k in range(3)]
            digests = [hashlib.sha256(told(base).encode()).hexdigest() for base, _, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([told(x[1]) for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())],
                names=names,
            )

    schema = f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and their secrets replaced; null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else redacted(t, scan(t)[1]) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
