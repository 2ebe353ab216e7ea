"""Secrets in texts and in what their encoded parts decode to.

Every layer (the text itself, then whatever a part of a layer decodes to) goes through a
worklist: it is searched for secrets and for percent-encoded, Unicode-escaped, base64 and
compressed parts, whose content is a new layer, until none is new.  Layers are taken one piece at a
time, a piece's own layers before the next piece, so that one piece of each open layer is held.  A content met
before at the same place of the text is not taken again, so cycles end; at another place it is.
Each character of a layer knows the range of the
text it came from, so findings are given as spans of the text.

Base64 is read over line breaks, and where a run as a whole does not decode to text, from all four
alignments for the stretches of text and the streams in it.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.session import ship_package

KINDS = ("assign", "access", "hex")
FINDING = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("layers", pa.string())]
    )
)
FINDING_DDL = "array<struct<kind:string,start:bigint,end:bigint,value:string,layers:string>>"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_RUN = re.compile(r"[^\x20\x09-\x0D\"'<>]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_LINE_BYTES = re.compile(rb"[A-Za-z0-9+/_-]+={0,2}")
_TEXT = re.compile(
    rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}"
)
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_STEMS = ("passw", "secret", "token", "api")


def _marks(allowed: str) -> bytes:
    return bytes(120 if chr(b) in allowed else 32 for b in range(256))


_HEX_MARKS = _marks("0123456789abcdef")
_BASE64_MARKS = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


#: Bytes of plain text.
_PLAIN = bytes([9, 10, 13, *range(32, 127)])


@dataclass(frozen=True)
class Limits:
    """A compressed stream of more than ``decoded_chars`` bytes is searched in pieces of about that size.  A piece
    ends before the word, or the block of base64 lines, that its last bytes belong to, and the next begins
    ``overlap`` bytes before that, so nothing is split.  A single word or block longer than ``longest`` is split
    nevertheless, and its text marked by kind ``unfinished``."""

    decoded_chars: int = 8 << 20
    overlap: int = 64 << 10
    longest: int = 16 << 20


class _Same:
    """The places of characters that all stand for one range of the layer around them."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start, self.end

    def within(self, outer: "_Same | _Each | None") -> "_Same":
        return self if outer is None else _Same(*outer.span(self.start, self.end))


class _Each:
    """The range of the layer around them that each of some characters stands for."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a]), int(self.ends[b - 1])

    def within(self, outer: "_Same | _Each | None") -> "_Same | _Each":
        if outer is None or isinstance(outer, _Same):
            return outer or self
        return _Each(outer.starts[self.starts], outer.ends[self.ends - 1])


def direct(text: str) -> list[tuple[str, int, int]]:
    """The secrets a text shows plainly, by start and then kind."""
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(stem.encode() in low for stem in _STEMS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MARKS):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _spliced(layer: str, at: int, end: int, pattern: re.Pattern, group: re.Pattern, codes, flat: bool) -> tuple[str, "_Same | _Each"]:
    """A run with its escapes replaced, and the places of its new characters."""
    if flat:
        return group.sub(lambda m: codes(pattern.findall(m[0])), layer[at:end]), _Same(at, end)
    out, starts, ends, k = [], [], [], at

    def plain(to: int) -> None:
        out.append(layer[k:to])
        starts.append(np.arange(k, to))
        ends.append(np.arange(k + 1, to + 1))

    for m in group.finditer(layer, at, end):
        plain(m.start())
        own = [(x.start(), x.end()) for x in pattern.finditer(layer, m.start(), m.end())]
        text = codes([layer[a:b] for a, b in own])
        if len(text) != len(own):
            own = [m.span()] * len(text)
        out.append(text)
        starts.append(np.array([a for a, _ in own], np.int64))
        ends.append(np.array([b for _, b in own], np.int64))
        k = m.end()
    plain(end)
    return "".join(out), _Each(np.concatenate(starts), np.concatenate(ends))


def _from_percent(parts: list[str]) -> str:
    return bytes(int(p[1:], 16) for p in parts).decode("utf-8", "replace")


def _from_escapes(parts: list[str]) -> str:
    raw = "".join(chr(int(p[2:], 16)) for p in parts)
    return raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _printable(raw: bytes) -> str | None:
    """The text that bytes hold, without a character cut off at their end."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":
            return None
        text = raw[: e.start].decode("utf-8")
    others = text.encode("utf-8").translate(None, _PLAIN).decode("utf-8")
    odd = sum(not c.isprintable() for c in others)
    return text if text and odd * 20 <= len(text) else None


def _open_from(held: bytes) -> int:
    """Where the word, or the block of base64 lines, begins that reaches to the end."""
    at = max(held.rfind(b" "), held.rfind(b"\n"), held.rfind(b"\t"), held.rfind(b"\r")) + 1
    while at:
        line = held.rfind(b"\n", 0, at) + 1
        if held[line:at].strip(b" \t>"):
            break  # the word stands within its line
        before = held.rfind(b"\n", 0, max(line - 1, 0)) + 1
        if not line or not _LINE_BYTES.fullmatch(held[before:line].strip(b" \t\r\n>")):
            break
        at = before
    return at


def _inflated(raw: bytes | memoryview, limits: Limits):
    """The content of a zlib stream or of all members of a gzip one: pieces, and whether something was split."""
    most = max(1, limits.decoded_chars)
    longest = max(most, limits.longest)
    held, fresh, data, worker, goal = b"", False, raw, zlib.decompressobj(wbits=47), most
    while _STREAM.match(data) or worker is not None:
        worker = worker or zlib.decompressobj(wbits=47)
        try:
            part = worker.decompress(data, max(1, goal - len(held)))
        except zlib.error:
            break
        held, fresh = held + part, fresh or bool(part)
        data = worker.unconsumed_tail
        if worker.eof:
            data, worker = worker.unused_data.lstrip(b"\0"), None
        elif not part and not data:
            break
        if len(held) >= goal:
            start = _open_from(held)
            keep = max(0, start - min(limits.overlap, most // 2))
            keep = max(held.rfind(b" ", 0, keep), held.rfind(b"\n", 0, keep)) + 1 or keep
            if start > keep or len(held) >= longest:
                if start > keep:
                    yield held[:start], False
                    held, fresh = held[keep:], start < len(held)
                else:
                    yield held, True
                    held, fresh = held[len(held) - most // 2 :], False
                goal = max(most, 2 * len(held))
            else:
                goal = 2 * len(held)  # one long word: read on until it ends
    if fresh:
        yield held, False


def _streams(raw: bytes | memoryview, limits: Limits):
    """The texts of the pieces of a compressed stream, and whether one was split."""
    for k, (piece, split) in enumerate(_inflated(raw, limits)):
        start = next((j for j in range(min(4, len(piece))) if piece[j] & 0xC0 != 0x80), 0) if k else 0
        yield _printable(piece[start:] if start else piece) or "", split


def _decoded(body: str) -> bytes:
    """Base64 without padding, up to the last whole byte."""
    body = body[:-1] if len(body) % 4 == 1 else body
    return binascii.a2b_base64(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _whole(body: str, at: np.ndarray | None, begin: int, end: int, limits: Limits) -> Iterable[tuple] | None:
    """What a base64 run that starts at its first character decodes to, or None.  ``at``: the places of its characters, if they matter."""
    if len(body) % 4 == 1:
        return None
    raw = _decoded(body)
    here = _Same(begin, end)
    if _STREAM.match(raw):
        pieces = _streams(raw, limits)
        if (first := next(pieces, None)) is not None:
            return (("base64+compressed", t, here, split) for t, split in chain([first], pieces) if t or split)
    text = _printable(raw)
    if text is None:
        return None
    if at is not None and text.isascii():
        k = np.arange(len(text))
        last = (k + 1) * 4 // 3 + 1
        ends = np.where(last >= len(body), end, at[np.minimum(last, len(body)) - 1] + 1)
        return [("base64", text, _Each(at[k * 4 // 3], ends), False)]
    return [("base64", text, here, False)]


def _parts(body: str, at: np.ndarray | None, begin: int, end: int, limits: Limits):
    """The stretches of text and the compressed streams that a run holds at any of the four alignments."""
    for shift in range(4):
        raw = _decoded(body[shift:])
        if at is None:
            for m in _STREAM.finditer(raw):
                for text, split in _streams(memoryview(raw)[m.start() :], limits):
                    if text or split:
                        yield "base64+compressed", text, _Same(begin, end), split
            for m in _TEXT.finditer(raw):
                yield "base64", m[0].decode("utf-8", "replace"), _Same(begin, end), False
            continue
        first = lambda a: at[shift + a * 4 // 3]  # noqa: B023, E731
        last = lambda b: at[np.minimum(len(body), shift + (b * 4 + 2) // 3) - 1] + 1  # noqa: B023, E731
        for m in _STREAM.finditer(raw):
            here = _Same(int(first(m.start())), int(last(len(raw))))
            for text, split in _streams(memoryview(raw)[m.start() :], limits):
                if text or split:
                    yield "base64+compressed", text, here, split
        for m in _TEXT.finditer(raw):
            text = m[0].decode("utf-8", "replace")
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
            begin = np.minimum(m.end() - 1, m.start() + np.cumsum(sizes) - sizes)
            yield "base64", text, _Each(first(begin), last(np.minimum(m.end(), begin + sizes))), False


def _from_base64(layer: str, limits: Limits, flat: bool):
    """What the base64 runs of a layer decode to, those over several lines first."""
    done: list[tuple[int, int]] = []
    for m in _LINES.finditer(layer):
        lines = list(_LINE.finditer(layer, m.start(), m.end()))
        where = lambda used: None if flat else np.concatenate([np.arange(*x.span()) for x in used])
        for used in (lines, lines[:-1]) if len(lines) > 2 else (lines,):
            end = m.end() if used is lines else used[-1].end()
            if (found := _whole("".join(x[0] for x in used), where(used), m.start(), end, limits)) is not None:
                yield from found
                done.append((m.start(), end))
                break
        else:
            for part in _parts("".join(x[0] for x in lines), where(lines), m.start(), m.end(), limits):
                yield part
                if part[1]:
                    done.append(part[2].span(0, len(part[1])))
    done.sort()
    k, reach = 0, 0
    for m in _BASE64.finditer(layer):
        while k < len(done) and done[k][0] <= m.start():
            reach = max(reach, done[k][1])
            k += 1
        if m.end() <= reach:
            continue
        body = m[0].rstrip("=")
        at = None if flat else np.arange(m.start(), m.end())
        found = _whole(body, at, m.start(), m.end(), limits)
        yield from _parts(body, at, m.start(), m.end(), limits) if found is None else found


def _unwrapped(layer: str, limits: Limits, flat: bool = False):
    """The encoded parts of a layer: how each was encoded, its content, its places, and whether something was split.

    ``flat``: all characters of the layer stand for one range, so only whole places matter.
    """
    if "%" in layer and _PERCENT.search(layer):
        for run in _RUN.finditer(layer):
            if _PERCENT.search(layer, run.start(), run.end()):
                yield "url", *_spliced(layer, run.start(), run.end(), _PERCENT, _PERCENTS, _from_percent, flat), False
    if "\\" in layer and _ESCAPE.search(layer):
        for run in _RUN.finditer(layer):
            if _ESCAPE.search(layer, run.start(), run.end()):
                yield "unicode", *_spliced(layer, run.start(), run.end(), _ESCAPE, _ESCAPES, _from_escapes, flat), False
    if b"x" * 16 in layer.encode("utf-8", "surrogatepass").translate(_BASE64_MARKS):
        yield from _from_base64(layer, limits, flat)


def scan(text: str, limits: Limits = Limits()) -> list[dict]:
    """All findings of a text: direct ones, then those of decoded layers as kind ``nested-...``."""
    plain = direct(text)
    found = [{"kind": k, "start": a, "end": b, "value": text[a:b], "layers": ""} for k, a, b in plain]
    known = {(k, a, b) for k, a, b in plain}
    seen = {_met(text, 0, len(text))}
    # A frame has the layers still to open and the open one: its parts, where its characters stand in the text, how it came
    # about.  The pieces of a stream each get a frame of their own, which is done before the next piece is inflated.
    frames: list[list] = [[[(text, None, "")], None, None, ""]]
    unfinished = False
    while frames:
        work, parts, places, path = frames[-1]
        if parts is None:
            if not work:
                frames.pop()
                continue
            layer, places, path = work.pop()
            frames[-1][1:] = _unwrapped(layer, limits, isinstance(places, _Same)), places, path
            continue
        if (part := next(parts, None)) is None:
            frames[-1][1] = None
            continue
        how, content, own, split = part
        unfinished |= split
        if not content:
            continue
        mapped = own.within(places)
        met = _met(content, *mapped.span(0, len(content)))
        if met in seen:
            continue
        seen.add(met)
        deeper = f"{path}>{how}" if path else how
        for kind, a, b in direct(content):
            span = mapped.span(a, b)
            if (kind, *span) not in known:
                known.add((kind, *span))
                found.append({"kind": f"nested-{kind}", "start": span[0], "end": span[1], "value": content[a:b], "layers": deeper})
        if how == "base64+compressed":
            frames.append([[(content, mapped, deeper)], None, None, ""])
        else:
            work.append((content, mapped, deeper))
        layer = content = part = None
    if unfinished:
        found.append({"kind": "unfinished", "start": 0, "end": len(text), "value": None, "layers": ""})
    order = [*KINDS, *(f"nested-{k}" for k in KINDS), "unfinished"]
    return sorted(found, key=lambda x: (x["start"], order.index(x["kind"]), x["end"]))


def _met(content: str, start: int, end: int) -> tuple[bytes, int, int]:
    """A content at a place of the text, in few bytes."""
    return hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).digest(), start, end


def secret_spans(docs: DataFrame, text: str = "text", into: str = "secrets", limits: Limits = Limits()) -> DataFrame:
    """All rows with their findings as ``array<struct<kind, start, end, value, layers>>``.

    Spans count code points, ends exclusive, and refer to the text even for findings in
    decoded layers.  A null or empty text has none.  A column named like ``into`` is
    replaced; repeated rows are scanned alike; an empty table gives an empty table.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf(returnType=FINDING_DDL)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py() or "", limits) for t in texts], FINDING)

    return docs.withColumn(into, found(F.col(text)))


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined, of some kinds or of all."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
