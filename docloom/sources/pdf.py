"""Text of PDF files with the standard library: objects, Flate streams, text operators, then lines, blocks and structure.

Simple fonts and fonts with a ToUnicode map are read; encrypted files are refused, and images are not read.
A file's pages are read in one task, the first MAX_PAGES of them.
"""

from __future__ import annotations

import re
import statistics
import zlib
from collections.abc import Iterator
from typing import NamedTuple

MAX_PAGES, MARGIN, MAX_FURNITURE, MAX_HEADING, HEADING = 300, 0.12, 90, 200, 1.12
_TOKEN = re.compile(rb"(\()|<<|>>|<([0-9A-Fa-f\s]*)>|/([^\s<>\[\]()/%{}]*)|([\[\]])|([-+]?(?:\d+\.?\d*|\.\d+))|([A-Za-z'\"*][A-Za-z0-9*'\"]*)|%[^\r\n]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Line(NamedTuple):
    page: int
    x: float
    y: float
    size: float
    bold: bool
    text: str


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after an open parenthesis, and the place after it."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if m := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(m[0], 8) & 255)
                at += len(m[0])
                continue
            at += 1
            if e not in b"\r\n":
                out += _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[tuple[str, object]]:
    at = 0
    while m := _TOKEN.search(data, at):
        at = m.end()
        if m[1]:
            text, at = _literal(data, at)
            yield "string", text
        elif m[2] is not None:
            digits = re.sub(rb"\s", b"", m[2])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m[3] is not None:
            yield "name", m[3].decode("latin-1")
        elif m[4]:
            yield m[4].decode(), None
        elif m[5]:
            yield "number", float(m[5])
        elif m[6]:
            yield "word", m[6].decode("latin-1")


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    raw = body[m.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" not in body[: m.start()]:
        return raw
    try:
        return zlib.decompressobj().decompress(raw)
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400]:
            packed, first, n = _stream(body), re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
            if packed and first and n:
                heads = [int(x) for x in packed[: int(first[1])].split()[: 2 * int(n[1])]]
                ends = [*heads[3::2], len(packed) - int(first[1])]
                for number, start, end in zip(heads[::2], heads[1::2], ends, strict=False):
                    found.setdefault(number, packed[int(first[1]) + start : int(first[1]) + end])
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2] or b"")] if m else []


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page dictionaries in order, with what they inherit after their own entries."""
    roots = [b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    out: list[bytes] = []

    def walk(body: bytes, inherited: bytes, depth: int) -> None:
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in _refs(body, b"Kids") if depth < 40 else ():
                walk(objects.get(k, b""), re.sub(rb"(?s)/Kids\s*\[.*?\]|/Type\s*/Pages", b"", body) + inherited, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body + inherited)

    for r in roots:
        walk(r, b"", 0)
    return out or [b for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)]


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the characters of each."""
    table: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    width = 1
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", cmap):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(code, 16)], width = text(to), max(width, len(code) // 2)
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", cmap):
        for lo, hi, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            width = max(width, len(lo) // 2)
            own = re.findall(rb"<([0-9A-Fa-f]+)>", several)
            for k in range(min(int(hi, 16) - int(lo, 16) + 1, 1 << 16)):
                if own and k < len(own):
                    table[int(lo, 16) + k] = text(own[k])
                elif to:
                    table[int(lo, 16) + k] = text(to)[:-1] + chr(ord(text(to)[-1]) + k) if text(to) else ""
    return width, table


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[str, tuple[bool, int, dict[int, str]]]:
    """Each font name of a page: whether it is bold, bytes of a code, characters."""
    m = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
    resources = objects.get(int(m[1]), b"") if m else page
    m = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", resources)
    held = objects.get(int(m[1]), b"") if m else (re.search(rb"(?s)/Font\s*<<(.*?)>>", resources) or [b"", b""])[1]
    out = {}
    for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", held):
        font = objects.get(int(ref), b"")
        to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
        width, table = _unicode_map(_stream(objects.get(int(to[1]), b""))) if to else (1, {})
        out[name.decode("latin-1")] = (bool(re.search(rb"/BaseFont\s*/[^\s/]*Bold", font)), width, table)
    return out


def _spans(content: bytes, fonts: dict) -> Iterator[tuple[float, float, float, bool, str]]:
    """(x, y, size, bold, text) of each shown string."""
    stack: list = []
    size, bold, width, table, lead = 10.0, False, 1, {}, 0.0
    line, x, y, scale = (0.0, 0.0), 0.0, 0.0, 1.0
    array: list | None = None

    def decoded(raw: bytes) -> str:
        if not table:
            return raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    for kind, value in _tokens(content):
        if kind == "[":
            array = []
        elif kind == "]":
            stack.append(array or [])
            array = None
        elif kind != "word":
            (stack if array is None else array).append(value)
        else:
            numbers = [v for v in stack if isinstance(v, float)]
            if value == "BT":
                line, x, y, scale = (0.0, 0.0), 0.0, 0.0, 1.0
            elif value == "Tf" and len(stack) >= 2 and numbers:
                size = numbers[-1]
                bold, width, table = fonts.get(stack[-2], (False, 1, {}))
            elif value == "TL" and numbers:
                lead = numbers[-1]
            elif value in ("Td", "TD") and len(numbers) >= 2:
                line = (line[0] + numbers[-2] * scale, line[1] + numbers[-1] * scale)
                x, y = line
                lead = -numbers[-1] if value == "TD" else lead
            elif value == "Tm" and len(numbers) >= 6:
                scale = abs(numbers[-3]) or abs(numbers[-4]) or 1.0
                line = (numbers[-2], numbers[-1])
                x, y = line
            elif value in ("T*", "'", '"'):
                line = (line[0], line[1] - (lead or size) * scale)
                x, y = line
            if value in ("Tj", "'", '"', "TJ") and stack:
                parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
                text = "".join(decoded(p) if isinstance(p, bytes) else " " if isinstance(p, float) and p < -200 else "" for p in parts)
                if text.strip():
                    yield x, y, round(size * scale, 1), bold, text
                x += 0.5 * size * scale * len(text)
            stack = []


def lines(data: bytes) -> tuple[list[Line], list[float], int]:
    """Lines of the first MAX_PAGES pages, y counted from the top; page heights; number of pages."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("PDF is password-protected")
    objects = _objects(data)
    pages = _pages(objects)
    if not pages:
        raise ValueError("PDF without pages")
    out, heights = [], []
    for number, page in enumerate(pages[:MAX_PAGES], 1):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", page)
        height = float(box[4]) - float(box[2]) if box else 792.0
        heights.append(height or 1.0)
        content = b"\n".join(_stream(objects.get(r, b"")) for r in _refs(page, b"Contents"))
        rows: dict[int, list] = {}
        for x, y, size, bold, text in _spans(content, _fonts(page, objects)):
            rows.setdefault(round(y), []).append((x, y, size, bold, text))
        for _, spans in sorted(rows.items(), reverse=True):
            spans.sort(key=lambda s: s[0])
            text = re.sub(r"\s+", " ", " ".join(s[4] for s in spans)).strip()
            out.append(Line(number, spans[0][0], height - spans[0][1], max(s[2] for s in spans), all(s[3] for s in spans), text))
    return out, heights, len(pages)


def elements(data: bytes) -> Iterator[tuple[str, int | None, str, int]]:
    """(element, level, text, page): headings by size or weight, paragraphs of lines that follow closely, without
    running heads, feet and page numbers."""
    found, heights, n_pages = lines(data)
    seen = len(heights)
    body = statistics.median([x.size for x in found]) if found else 10.0
    norm = lambda t: re.sub(r"\d+", "#", re.sub(r"\s+", "", t.lower()))
    margin = [x for x in found if len(x.text) <= MAX_FURNITURE and not MARGIN * heights[x.page - 1] <= x.y <= (1 - MARGIN) * heights[x.page - 1]]
    on: dict[str, set[int]] = {}
    for x in margin:
        on.setdefault(norm(x.text), set()).add(x.page)
    often = {k for k, pages in on.items() if len(pages) >= max(3, round(0.6 * seen))}
    number = re.compile(r"(page)?\d{1,4}(\|?page)?(of\d{1,4})?")
    kept = [x for x in found if not (number.fullmatch(re.sub(r"\s+", "", x.text.lower())) or norm(x.text) in often)]
    block: list[Line] = []

    def flush() -> Iterator[tuple[str, int | None, str, int]]:
        if block:
            text, size = "\n".join(x.text for x in block), max(x.size for x in block)
            if len(block) == 1 and len(text) < MAX_HEADING and (size >= HEADING * body or (block[0].bold and size >= body)):
                ratio = size / body
                yield "heading", 1 if ratio >= 1.6 else 2 if ratio >= 1.35 else 3 if ratio >= 1.18 else 4, text, block[0].page
            else:
                yield "paragraph", None, text, block[0].page
        block.clear()

    for x in kept:
        if block and (x.page != block[-1].page or x.size != block[-1].size or x.bold != block[-1].bold or x.y - block[-1].y > 1.6 * x.size):
            yield from flush()
        block.append(x)
    yield from flush()
    if n_pages > seen:
        yield "paragraph", None, f"[Only the first {seen} of {n_pages} pages were read.]", seen
