"""Secret scans with a recursive decoding worklist.

Every text is searched for the three base kinds. Then the layers hidden in it
are unwrapped: percent escapes, backslash escapes of code points, all escapes of
JSON and C strings, base64 runs (wrapped, indented, or joined from quoted strings;
glued to a path or prefix), and compressed bytes inside base64. Each decoded layer is searched in the same
way and unwrapped further, until no layer yields a new one; a layer seen before
is not taken up again, which ends cycles. Every character of a layer knows the
span of the original text it came from, so a find in any layer is reported as a
span of the original (a base64 run maps to the whole run). Finds of layers are
added to the base finds, equal spans once.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_blocks

# The base kinds in their listed order.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # the whole runs of 32 or more
KINDS = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
STRING_ESCAPE = re.compile(ESCAPE.pattern + r"""|\\([nrtbfav0/"'\\])""")
SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "0": "\0",
         "/": "/", '"': '"', "'": "'", "\\": "\\"}
# The shortest find has 14 bytes (token=12345678), 19 characters of base64 without padding.
LEAST_RUN = 19
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{19,}={0,2}")
# What may stand between two lines of one run: a line break with blanks around it, or the
# end of one quoted string and the start of the next, with or without an operator.
JOIN = re.compile(r"""[\x20\t]*+\r?\n[\x20\t]*+"""
                  r"""|["'][\x20\t]*+[+.,&\\]?[\x20\t]*+(?:\r?\n[\x20\t]*+)?[+.&]?[\x20\t]*+["']""")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:(?:" + JOIN.pattern
                     + r")[A-Za-z0-9+/_-]++)+={0,2}")
# Bytes without so many ASCII characters on end (one, two or four bytes wide) hold no find,
# escape or base64 run that leads to one.
LEGIBLE = re.compile(rb"[\t\n\r\x20-\x7e]{14}|(?:[\t\n\r\x20-\x7e]\0){13}|(?:[\t\n\r\x20-\x7e]\0{3}){13}")
LEGIBLE_TEXT = re.compile(r"[\t\n\r\x20-\x7e]{14,}")
# How gzip, bzip2, xz and zlib streams begin in base64.
MAGIC = re.compile(r"(?=H4sI|Qlpo[MNO]|/Td6WFoA|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r]))")
PROBE_CHARS = 4096

# Decoded bytes are unpacked in chunks (a multiple of four bytes) and searched in
# windows of about so many characters.
CHUNK_BYTES = 1 << 20
WINDOW_CHARS = 4 << 20
# Places that no find, escape or base64 run spans, in the text itself or after unwrapping.
SAFE = re.compile(r"""[^A-Za-z0-9+/_.=:,&"'%\\{}\x20\t\r\n-]|(?<=\n)(?=\n)|(?<=[g-zG-Z])(?=\x20[A-Za-z0-9])""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base finds, sorted."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; ``starts`` and ``ends`` give each character's span of the original.

    Without arrays the characters are the original's own (``whole`` None) or all
    come from the one span ``whole``.
    """

    __slots__ = ("text", "starts", "ends", "whole")

    def __init__(self, text, starts=None, ends=None, whole=None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def rebuilt(self, pieces: list[tuple[int, int, str]]) -> Layer:
        """The layer with ``(start, end, new text)`` pieces put in place of the old."""
        if self.whole is not None:
            out, at = [], 0
            for s, e, new in pieces:
                out += [self.text[at:s], new]
                at = e
            return Layer("".join(out) + self.text[at:], whole=self.whole)
        starts = np.arange(len(self.text)) if self.starts is None else self.starts
        ends = np.arange(1, len(self.text) + 1) if self.ends is None else self.ends
        texts, ss, es, at = [], [], [], 0
        for s, e, new in pieces:
            texts += [self.text[at:s], new]
            a, b = self.span(s, e)
            ss += [starts[at:s], np.full(len(new), a)]
            es += [ends[at:s], np.full(len(new), b)]
            at = e
        texts.append(self.text[at:])
        return Layer("".join(texts), np.concatenate([*ss, starts[at:]]), np.concatenate([*es, ends[at:]]))


def safe_cut(text: str) -> int:
    """The last place near the end at which ``text`` may be cut, 0 if there is none."""
    size = 4096
    while True:
        at, cut = max(0, len(text) - size), 0
        for m in SAFE.finditer(text, at):
            cut = m.end()
        if cut or not at:
            return cut
        size *= 16


class Windows:
    """Incremental decoding into windows cut at safe places; one without such a place grows."""

    def __init__(self, coding: str):
        self.decode = codecs.getincrementaldecoder(coding)("replace").decode
        self.parts, self.size, self.wanted = [], 0, WINDOW_CHARS

    def feed(self, data: bytes, final: bool = False) -> Iterator[str]:
        self.parts.append(self.decode(data, final))
        self.size += len(self.parts[-1])
        if self.size < self.wanted and not final:
            return
        text = "".join(self.parts)
        cut = len(text) if final else safe_cut(text)
        self.parts, self.size = [text[cut:]], len(text) - cut
        self.wanted = max(WINDOW_CHARS, 2 * self.size)
        if cut:
            yield text[:cut]


def even_chunks(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes in chunks of ``CHUNK_BYTES``, the last one shorter."""
    size, kept = CHUNK_BYTES, b""
    for chunk in chunks:
        kept += chunk
        full = len(kept) - len(kept) % size
        for at in range(0, full, size):
            yield kept[at:at + size]
        kept = kept[full:]
    if kept:
        yield kept


def texts(chunks: Iterable[bytes]) -> Iterator[str]:
    """The bytes as text: UTF-8 with the undecodable bytes replaced, and UTF-16 or
    UTF-32 of both byte orders from where a byte order mark or zero bytes suggest it."""
    windows = {"utf-8": Windows("utf-8")}
    for i, chunk in enumerate(even_chunks(chunks)):
        wide = []
        if b"\0" in chunk or i == 0 and chunk[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            wide += ["utf-16-le", "utf-16-be"]
        if b"\0\0\0" in chunk:
            wide += ["utf-32-le", "utf-32-be"]
        for coding in wide:
            if coding not in windows:
                windows[coding] = Windows(coding)
        for w in windows.values():
            yield from w.feed(chunk)
    for w in windows.values():
        yield from w.feed(b"", True)


def opened(head: bytes):
    """A decompressor for bytes that begin as a gzip, zlib, bzip2 or xz stream, else None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Decompressed bytes of compressed streams one after the other, up to an error or other bytes."""
    chunks = (c for c in chunks if c)
    head = b""
    while True:
        while len(head) < 6 and (more := next(chunks, None)):
            head += more
        box = opened(head)
        if box is None:
            return
        try:
            while not box.eof:
                out = box.decompress(head, CHUNK_BYTES)
                head = getattr(box, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not box.eof and not (head := next(chunks, b"")):
                    return  # cut short
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        head = box.unused_data.lstrip(b"\0")  # padding between streams
        while not head and (more := next(chunks, None)):
            head = more.lstrip(b"\0")


def decoded(body: str, start: int = 0) -> Iterator[bytes]:
    """The bytes of ``body`` from ``start`` on, in chunks."""
    end = len(body) - ((len(body) - start) % 4 == 1)  # six bits left over are no byte
    for at in range(start, end, 4 * CHUNK_BYTES):
        part = body[at:min(at + 4 * CHUNK_BYTES, end)]
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def begins(body: str, start: int) -> bool:
    """Whether a compressed stream begins at ``start``.

    Its first bytes must unpack without an error. A zlib stream inside a run has to be
    whole as well (its checksum holds), as its two first bytes turn up in any noise.
    """
    head = next(decoded(body[start:start + PROBE_CHARS]), b"")
    box = opened(head)
    if box is None:
        return False
    try:
        box.decompress(head, CHUNK_BYTES)
        if start and head[0] == 0x78:
            box = zlib.decompressobj()
            for chunk in decoded(body, start):
                while chunk and not box.eof:
                    box.decompress(chunk, CHUNK_BYTES)
                    chunk = box.unconsumed_tail
            return box.eof
        return True
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return False


def from_base64(run: str) -> Iterator[str]:
    """Texts a base64 run stands for: of the decoded bytes, and of what they unpack to.

    What stands before the base64 in the same run (a path, a prefix) puts it out of
    step, so the bytes are read at all four alignments, and compressed streams from
    wherever one begins. Long texts come in windows. Every level unpacks anew from the
    decoded bytes, so no level is held in memory.
    """
    body = JOIN.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    seen = {hashlib.sha256().digest()}
    for start in range(min(4, len(body))):
        if legible(decoded(body, start)):
            yield from levels(body, start, 0, seen)
        elif begins(body, start):
            yield from levels(body, start, 1, seen)
    for m in MAGIC.finditer(body, 4):
        if begins(body, m.start()):
            yield from levels(body, m.start(), 1, seen)


def legible(chunks: Iterable[bytes]) -> bool:
    tail = b""
    for chunk in chunks:
        if LEGIBLE.search(tail + chunk):
            return True
        tail = chunk[-64:]
    return False


def levels(body: str, start: int, depth: int, seen: set[bytes]) -> Iterator[str]:
    """Texts of the bytes from ``start`` on, unpacked ``depth`` times and more until nothing new."""
    while True:
        digest, level = hashlib.sha256(), decoded(body, start)
        for _ in range(depth):
            level = unpacked(level)
        yield from texts(hashed(level, digest))
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        depth += 1


def hashed(chunks: Iterable[bytes], digest) -> Iterator[bytes]:
    for chunk in chunks:
        digest.update(chunk)
        yield chunk


def base64_runs(text: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the runs in ``text`` that may be base64, each once.

    A run is one line's, or lines of equal width (or of 40 and more characters)
    and the line after them, which may have any length. As that line may also be
    other text, the lines before it count as a run of their own unless it is
    padded or of full width.
    """
    for m in BASE64.finditer(text):
        yield m.span()
    for m in WRAPPED.finditer(text):
        cuts = [m.start(), *(at for x in JOIN.finditer(text, *m.span()) for at in x.span()), m.end()]
        lines = list(zip(cuts[::2], cuts[1::2]))
        widths = [e - s for s, e in lines]
        padded = text[m.end() - 1] == "="
        last = len(lines) - 1
        found = set()
        for same in (lambda i, j: widths[j] == widths[i], lambda i, j: widths[j] >= 40):
            i = 0
            while i < last:
                j = i
                while j < last and same(i, j + 1):
                    j += 1
                if same(i, i) and widths[i] >= 4:
                    # Lines i to j are full; the one after them ends the run if it is shorter.
                    if j < last and widths[j + 1] < widths[j]:
                        found.add((lines[i][0], lines[j + 1][1]))
                        if j > i and not (padded and j + 1 == last):
                            found.add((lines[i][0], lines[j][1]))
                    elif j > i:
                        found.add((lines[i][0], lines[j][1]))
                i = j + 1
        yield from sorted(r for r in found if r[1] - r[0] >= LEAST_RUN)


def escapes(pattern: re.Pattern, text: str) -> list[tuple[int, int, str]]:
    """``(start, end, character)`` of the backslash escapes that ``pattern`` finds."""
    pieces = []
    for m in pattern.finditer(text):
        point = next((g for g in m.groups()[:4] if g), None)
        if point is None:
            pieces.append((m.start(), m.end(), SHORT[m.group(5)]))
        elif (value := int(point, 16)) < 0x110000 and not 0xD800 <= value < 0xE000:
            pieces.append((m.start(), m.end(), chr(value)))
    return pieces


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers one decoding step inside ``layer``."""
    text = layer.text
    if "%" in text:
        pieces = []
        for m in PERCENT.finditer(text):
            at = m.start()
            raw = bytes.fromhex(m.group().replace("%", ""))
            # One piece per code point keeps spans narrow; stray bytes stay as they are.
            i = 0
            while i < len(raw):
                width = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                try:
                    char = raw[i:i + width].decode("utf-8")
                except UnicodeDecodeError:
                    i += 1
                    continue
                pieces.append((at + 3 * i, at + 3 * (i + width), char))
                i += width
        if pieces:
            yield layer.rebuilt(pieces)
    if "\\" in text:
        points = escapes(ESCAPE, text)
        if points:
            yield layer.rebuilt(points)
        strings = escapes(STRING_ESCAPE, text)
        if strings != points:
            yield layer.rebuilt(strings)
    for start, end in base64_runs(text):
        for inner in from_base64(text[start:end]):
            # All places are the run's, so only what can hold a find or lead to one is kept.
            kept = "\ufffd".join(LEGIBLE_TEXT.findall(inner))
            if kept:
                yield Layer(kept, whole=layer.span(start, end))


def digest_of(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base finds plus the finds of every decoded layer, sorted, equal ones once."""
    found = set(base)
    seen = {(digest_of(text), None)}
    # Depth first: only the layers around the present one are held.
    work = [unwrapped(Layer(text))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        key = (digest_of(inner.text), inner.whole)
        if key in seen:
            continue
        seen.add(key)
        work.append(unwrapped(inner))
        for start, kind, end in base_spans(inner.text):
            a, b = inner.span(start, end)
            found.add((a, kind, b))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base finds, their digest, and all spans.

    A null or empty text has no finds. Repeated rows give repeated results. The
    whole text is searched, whatever its length; spans count code points. An empty
    table gives an empty result; other columns are not read.
    """
    src = docs.select(id_col, text)
    schema = (f"{id_col} {src.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, "
              "n_hex long, base_sha256 string, spans string")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in column_blocks(batches):
            counts, digests, spans = [[], [], []], [], []
            for t in block.column(1).to_pylist():
                base = base_spans(t) if t else []
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(t, base)) if t else "")
            yield pa.RecordBatch.from_arrays(
                [block.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return src.mapInArrow(scanned, schema)
