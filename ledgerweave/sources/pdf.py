"""Structure and text of PDF files (S14, S15): objects by a scan, the page tree, fonts with their maps to Unicode."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Share of printable characters from which a page's text layer counts as readable.
READABLE = 0.6
#: How deep a page tree or nested values may go, and what a stream may unpack to.
DEEPEST, UNPACKED = 64, 256 << 20


class Name(str):
    """A name object, without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int


class Word(bytes):
    """A keyword or an operator."""


class Scanner:
    """Values and keywords of PDF syntax, one after another."""

    TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
    REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
    NUMBER = re.compile(rb"[-+]?(\d+\.?\d*|\.\d+)")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blanks(self) -> None:
        while self.at < len(self.data):
            if self.data[self.at] in SPACE:
                self.at += 1
            elif self.data[self.at] == 0x25:  # a comment
                ends = [e for e in (self.data.find(b"\n", self.at), self.data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(self.data))
            else:
                return

    def value(self, references: bool = True, depth: int = 0) -> object:
        """The next value; None at the end and where a closing bracket stands alone."""
        self.blanks()
        data, at = self.data, self.at
        if at >= len(data) or depth > DEEPEST:
            self.at = len(data)
            return None
        two, one = data[at : at + 2], data[at : at + 1]
        if two == b"<<":
            self.at += 2
            return self._pairs(references, depth)
        if one == b"[":
            self.at += 1
            return self._items(b"]", references, depth)
        if one == b"(":
            return self._string()
        if one == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if one == b"/":
            m = self.TOKEN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]).decode("latin-1") if m else "")
        if one in (b")", b">", b"]", b"{", b"}"):
            self.at += 1
            return Word(one)
        if references and (m := self.REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]))
        m = self.TOKEN.match(data, at)
        self.at = m.end()
        if n := self.NUMBER.fullmatch(m[0]):
            return float(n[0]) if b"." in n[0] else int(n[0])
        return {b"true": True, b"false": False, b"null": None}.get(m[0], Word(m[0]))

    def _items(self, closing: bytes, references: bool, depth: int) -> list:
        out = []
        while True:
            self.blanks()
            if self.at >= len(self.data):
                return out
            if self.data.startswith(closing, self.at):
                self.at += len(closing)
                return out
            out.append(self.value(references, depth + 1))

    def _pairs(self, references: bool, depth: int) -> dict:
        flat = self._items(b">>", references, depth)
        return {k: v for k, v in zip(flat[::2], flat[1::2], strict=False) if isinstance(k, Name)}

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                    continue
                following = data[at + 1 : at + 2]
                if following not in (b"\n", b"\r"):
                    out += ESCAPES.get(following, following)
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            at += 1
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)


@dataclass
class Document:
    values: dict[int, object] = field(default_factory=dict)
    streams: dict[int, bytes] = field(default_factory=dict)
    encrypted: bool = False

    def of(self, x: object) -> object:
        """What a reference stands for."""
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                return x
            x = self.values.get(x.number)
        return None

    def stream(self, x: object) -> bytes:
        return self.streams.get(x.number, b"") if isinstance(x, Ref) else b""

    def pages(self) -> list[dict]:
        """Pages in the order of the tree, each with what it inherits; without a tree those that say they are pages."""
        out, seen = [], set()

        def walk(ref: object, above: dict, depth: int) -> None:
            node = self.of(ref)
            if not isinstance(node, dict) or depth > DEEPEST or (isinstance(ref, Ref) and ref.number in seen):
                return
            if isinstance(ref, Ref):
                seen.add(ref.number)
            own = above | {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}
            kids = self.of(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | {"Contents": node.get("Contents")})

        for value in [v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"][-1:]:
            walk(value.get("Pages"), {}, 0)
        if not out:
            for n, value in sorted(self.values.items()):
                if isinstance(value, dict) and value.get("Type") == "Page":
                    walk(Ref(n), {}, 0)
        return out


def unpacked(head: dict, raw: bytes) -> bytes:
    """A stream's bytes; filters other than Flate leave it empty, and a damaged end is left out."""
    filters = head.get("Filter")
    for name in filters if isinstance(filters, list) else [filters] if filters else []:
        if name not in ("FlateDecode", "Fl"):
            return b""
        z = zlib.decompressobj()
        try:
            raw = z.decompress(raw, UNPACKED)
        except zlib.error:
            return b""
    return _without_predictor(head, raw)


def _without_predictor(head: dict, raw: bytes) -> bytes:
    parms = head.get("DecodeParms")
    if not isinstance(parms, dict) or parms.get("Predictor", 1) < 10:
        return raw
    width = -(-parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    size, before, out = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8), bytearray(width), bytearray()
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for k in range(width):
            left, up, corner = row[k - size] if k >= size else 0, before[k], before[k - size] if k >= size else 0
            guess = (0, left, up, (left + up) // 2, min((left, up, corner), key=lambda x: abs(left + up - corner - x)))[kind if kind < 5 else 0]  # noqa: B023
            row[k] = (row[k] + guess) & 255
        out += row
        before = row
    return bytes(out)


OBJECT = re.compile(rb"(?<![^\x00\t\n\x0c\r >])(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b")


def read(data: bytes) -> Document:
    """All objects of a file by a scan; the last revision of a number counts. A stream is as long as it says, where that holds."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    doc, at = Document(), 0
    while m := OBJECT.search(data, at):
        scanner = Scanner(data, m.end())
        value, number = scanner.value(), int(m[1])
        scanner.blanks()
        at = max(scanner.at, m.end())
        doc.streams.pop(number, None)
        doc.values[number] = value
        if data.startswith(b"stream", scanner.at) and isinstance(value, dict):
            start = scanner.at + 6
            start += 2 if data[start : start + 2] == b"\r\n" else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
            length = doc.of(value.get("Length"))
            end = start + length if isinstance(length, int) and length >= 0 else -1
            if end < 0 or not data[end : end + 12].lstrip().startswith(b"endstream"):
                end = data.find(b"endstream", start)
                end = len(data) if end < 0 else end
            doc.streams[number] = unpacked({k: doc.of(v) for k, v in value.items()}, data[start:end])
            at = end
    doc.encrypted = b"/Encrypt" in data
    for number, value in list(doc.values.items()):  # objects within streams, where no later revision stands outside
        if isinstance(value, dict) and value.get("Type") == "ObjStm":
            body, first = doc.streams.get(number, b""), doc.of(value.get("First"))
            scanner = Scanner(body)
            heads = [scanner.value(False) for _ in range(2 * (doc.of(value.get("N")) or 0))]
            for own, place in zip(heads[::2], heads[1::2], strict=False):
                if isinstance(own, int) and isinstance(place, int) and isinstance(first, int):
                    doc.values.setdefault(own, Scanner(body, first + place).value())
    return doc


def _characters(code: bytes) -> str:
    return code.rjust(len(code) + len(code) % 2, b"\0").decode("utf-16-be", "replace")


def unicode_map(stream: bytes) -> dict[int, str]:
    """Codes and their characters from a ToUnicode map: single codes, ranges that count on, ranges with a list."""
    out: dict[int, str] = {}
    scanner, stack = Scanner(stream), []
    while (token := scanner.value(False)) is not None or scanner.at < len(stream):
        if not isinstance(token, Word):
            stack.append(token)
            continue
        if token == b"endbfchar":
            for code, text in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(text, bytes):
                    out[int.from_bytes(code, "big")] = _characters(text)
        elif token == b"endbfrange":
            for low, high, text in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not (isinstance(low, bytes) and isinstance(high, bytes)):
                    continue
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                codes = range(first, min(last, first + 0xFFFF) + 1)
                if isinstance(text, list):
                    out.update((c, _characters(t)) for c, t in zip(codes, text, strict=False) if isinstance(t, bytes))
                elif isinstance(text, bytes) and text:
                    head, tail = _characters(text)[:-1], ord(_characters(text)[-1])
                    out.update((c, head + chr(min(tail + k, 0x10FFFF))) for k, c in enumerate(codes))
        stack = []
    return out


class Font:
    """How a font's codes read: by its map; without one a simple font as Windows Latin 1, and a composite one not at all."""

    def __init__(self, doc: Document, head: dict):
        self.wide = head.get("Subtype") == "Type0"
        self.map = unicode_map(doc.stream(head.get("ToUnicode")))

    def text(self, raw: bytes) -> str:
        codes = (raw[k] << 8 | raw[k + 1] for k in range(0, len(raw) - 1, 2)) if self.wide else raw
        return "".join(self.map.get(c) or ("�" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)


Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def shown(content: bytes, fonts: dict[str, Font]) -> Iterator[tuple[str, float, float, float]]:
    """(text, x, y, height) of each text that a page's content shows, in its order; text and page matrices both count."""
    scanner, stack = Scanner(content), []
    page, kept, line, at, font, size, leading = SAME, [], SAME, SAME, None, 0.0, 0.0
    while (token := scanner.value(False)) is not None or scanner.at < len(content):
        if not isinstance(token, Word):
            stack.append(token)
            continue
        numbers = [x for x in stack if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if token == b"q":
            kept.append(page)
        elif token == b"Q" and kept:
            page = kept.pop()
        elif token == b"cm" and len(numbers) == 6:
            page = _times(tuple(map(float, numbers)), page)
        elif token == b"BT":
            line = at = SAME
        elif token == b"Tf" and len(stack) >= 2 and isinstance(stack[-2], Name):
            font, size = fonts.get(stack[-2]), float(stack[-1]) if numbers else 0.0
        elif token == b"TL" and numbers:
            leading = float(numbers[-1])
        elif token in (b"Td", b"TD") and len(numbers) >= 2:
            leading = -float(numbers[-1]) if token == b"TD" else leading
            line = at = _times((1, 0, 0, 1, float(numbers[-2]), float(numbers[-1])), line)
        elif token == b"Tm" and len(numbers) >= 6:
            line = at = tuple(map(float, numbers[-6:]))
        elif token in (b"T*", b"'", b'"'):
            line = at = _times((1, 0, 0, 1, 0, -leading), line)
        elif token == b"BI":  # an image within the content
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, scanner.at)
            scanner.at = end.end() if end else len(content)
        if token in (b"Tj", b"TJ", b"'", b'"') and stack:
            parts = stack[-1] if isinstance(stack[-1], list) else [stack[-1]]
            text = "".join(font.text(p) if font else p.decode("cp1252", "replace") for p in parts if isinstance(p, bytes))
            if text.strip():
                place = _times(at, page)
                yield text, place[4], place[5], abs(size) * (place[2] ** 2 + place[3] ** 2) ** 0.5
        stack = []


def texts(data: bytes) -> Iterator[tuple[int, str, str | None, dict[str, str]]]:
    """Rows of source objects: each text with its place as shares of its page, and each page's text layer."""
    doc = read(data)
    if doc.encrypted:
        raise ValueError("encrypted")
    for number, page in enumerate(doc.pages(), 1):
        box = doc.of(page.get("MediaBox"))
        corners = [float(doc.of(x)) for x in box] if isinstance(box, list) and len(box) == 4 else [0.0, 0.0, 595.0, 842.0]
        left, right, low, high = min(corners[::2]), max(corners[::2]), min(corners[1::2]), max(corners[1::2])
        width, height, turned = (right - left) or 1.0, (high - low) or 1.0, doc.of(page.get("Rotate")) or 0
        resources = doc.of(page.get("Resources"))
        table = doc.of(resources.get("Font")) if isinstance(resources, dict) else None
        heads = {name: doc.of(ref) for name, ref in table.items()} if isinstance(table, dict) else {}
        fonts = {name: Font(doc, head) for name, head in heads.items() if isinstance(head, dict)}
        refs = page.get("Contents")
        refs = refs if isinstance(refs, list) else doc.of(refs) if isinstance(doc.of(refs), list) else [refs]
        order = readable = total = 0
        for text, x, y, size in shown(b"\n".join(doc.stream(r) for r in refs), fonts):
            order += 1
            total, readable = total + len(text), readable + sum(c.isprintable() and c != "�" for c in text)
            share = lambda v, start, span: f"{min(1.0, max(0.0, (v - start) / span)):.3f}"
            yield number, f"page[{number}]/text[{order}]", text, {
                "kind": "text", "x": share(x, left, width), "y": share(y, low, height), "font_size": f"{size:g}", "font_share": f"{size / height:.6f}", "order": str(order), "rotation": str(turned),
            }
        layer = "scan" if not total else "readable" if readable >= READABLE * total else "unreadable"
        yield number, f"page[{number}]/layer", None, {"kind": "layer", "layer": layer, "width": f"{width:g}", "height": f"{height:g}", "rotation": str(turned)}
