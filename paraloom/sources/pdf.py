"""The text layer of PDF files, page by page, in plain Python.

Covers what digital reports use: compressed and plain streams, object streams,
the page tree with inherited resources, the text operators, and fonts with or
without a map to Unicode.  Encrypted files and pictures have no text here; any
other extractor can be given in its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
TOKEN = re.compile(
    rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[-+]?\d*\.?\d+|true|false|null|[A-Za-z'\"*][A-Za-z0-9'\"*]*|\{|\}")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOST_DEPTH = 60


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    """A PDF name."""


class Word(str):
    """A bare word: an operator, or the R of a reference."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that opens before ``at``."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at:at + 1]
        if c == b"\\":
            n = data[at + 1:at + 2]
            octal = re.match(rb"[0-7]{1,3}", data[at + 1:at + 4])
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at += 1 + len(octal.group())
                continue
            if n in b"\r\n":
                at += 3 if data[at + 1:at + 3] == b"\r\n" else 2
                continue
            out += ESCAPES.get(n, n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    raise ValueError("a string does not end")


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, place after it); strings are bytes, numbers floats, brackets words."""
    while m := TOKEN.search(data, at):
        t, at = m.group(), m.end()
        if t == b"(":
            value, at = _string(data, at)
            yield value, at
        elif t[:1] == b"%":
            continue
        elif t[:1] == b"/":
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h.group(1), 16)), t[1:].decode("latin-1"))), at
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            yield float(t), at
        else:
            yield Word(t.decode("latin-1")), at


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """One value: dictionaries are dict, arrays lists, references ``Ref``."""
    stack: list[list] = [[]]
    for value, end in tokens(data, at):
        top = stack[-1]
        if value in ("<<", "[") and isinstance(value, Word):
            stack.append([])
        elif value in (">>", "]") and isinstance(value, Word):
            done = stack.pop()
            if not stack:
                raise ValueError("a bracket too many")
            stack[-1].append(dict(zip(done[::2], done[1::2])) if value == ">>" else done)
        elif isinstance(value, Word) and value == "R" and len(top) >= 2:
            top[-2:] = [Ref(int(top[-2]))]
        elif isinstance(value, Word) and value in ("stream", "endobj", "endstream"):
            break
        else:
            top.append({"true": True, "false": False, "null": None}.get(value, value) if isinstance(value, Word) else value)
        at = end
        if len(stack) == 1 and stack[0] and isinstance(stack[0][0], (dict, list)):
            break
    return (stack[0][0] if stack[0] else None), at


class Document:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no PDF file")
        self.content = content
        self.values: dict[int, tuple[object, bytes | None]] = {}
        for m in OBJECT.finditer(content):
            value, end = parse(content, m.end())
            stream = None
            s = re.compile(rb"\s*stream\r?\n").match(content, end)
            if s and isinstance(value, dict):
                stop = content.find(b"endstream", s.end())
                stream = content[s.end():stop if stop >= 0 else len(content)]
            self.values[int(m.group(1))] = (value, stream)
        if any(isinstance(v, dict) and "Encrypt" in v for v, _ in self.values.values()) or b"/Encrypt" in content[content.rfind(b"trailer"):]:
            raise ValueError("the file is encrypted")
        for value, stream in list(self.values.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, self._decoded(value, stream))

    def _unpack(self, about: dict, data: bytes) -> None:
        first, n = int(self.get(about["First"])), int(self.get(about["N"]))
        numbers = [int(x) for x in data[:first].split()[:2 * n]]
        for number, offset in zip(numbers[::2], numbers[1::2]):
            self.values.setdefault(number, (parse(data, first + offset)[0], None))

    def get(self, value):
        for _ in range(MOST_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.values.get(value.number, (None, None))[0]
        return None

    def stream(self, ref) -> bytes:
        value, raw = self.values.get(ref.number, (None, None)) if isinstance(ref, Ref) else (ref, None)
        return self._decoded(value, raw) if raw is not None else b""

    def _decoded(self, about: dict, raw: bytes) -> bytes:
        length = self.get(about.get("Length"))
        if isinstance(length, float) and 0 < length <= len(raw):
            raw = raw[:int(length)]
        filters = self.get(about.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {self.get(f)}")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        roots = [v for v, _ in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(ref, inherited: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > MOST_DEPTH:
                return
            own = inherited | {k: node[k] for k in ("Resources",) if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            elif node.get("Type") == "Page":
                out.append(own | node)

        if roots:
            walk(roots[-1].get("Pages"), {}, 0)
        return out

    def fonts(self, page: dict) -> dict[str, Font]:
        resources = self.get(page.get("Resources")) or {}
        listed = self.get(resources.get("Font")) or {}
        return {name: Font(self, self.get(f) or {}) for name, f in listed.items()}


class Font:
    """Turns the codes of a string into text."""

    def __init__(self, document: Document, about: dict):
        self.wide = about.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        if "ToUnicode" in about:
            self._read(document.stream(about["ToUnicode"]))

    def _read(self, cmap: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        code = lambda b: int.from_bytes(b, "big")
        held: list = []
        for value, _ in tokens(cmap):
            if not isinstance(value, Word) or value in ("[", "]"):
                held.append(value)
                continue
            if value == "endbfchar":
                pairs = [v for v in held if isinstance(v, bytes)]
                self.map |= {code(a): text(b) for a, b in zip(pairs[::2], pairs[1::2])}
            elif value == "endbfrange":
                self._ranges(held, code, text)
            elif value == "endcodespacerange":
                self.wide = any(len(v) > 1 for v in held if isinstance(v, bytes))
            held = []

    def _ranges(self, held: list, code, text) -> None:
        items = iter([v for v in held if isinstance(v, bytes) or v in ("[", "]")])
        for low in items:
            high, to = next(items), next(items)
            for c in range(code(low), code(high) + 1):
                if to == "[":
                    to_c = next(items)
                    if to_c == "]":
                        break
                    self.map[c] = text(to_c)
                else:
                    start = text(to)
                    self.map[c] = start[:-1] + chr(ord(start[-1]) + c - code(low))
            if to == "[" and c == code(high):
                next(items, None)

    def text(self, data: bytes) -> str:
        if self.wide:
            codes = [int.from_bytes(data[i:i + 2], "big") for i in range(0, len(data), 2)]
            return "".join(self.map.get(c, "") for c in codes)
        return "".join(self.map.get(c) or bytes([c]).decode("cp1252", "replace") for c in data)


def page_text(content: bytes, fonts: dict[str, Font]) -> str:
    """The strings of a content stream in its order; a move down is a new line, one of more than a line and a half a paragraph."""
    out: list[str] = []
    font, size, leading, y, line_y, scale = None, 1.0, 0.0, 0.0, None, 1.0
    held: list = []

    def show(data: bytes) -> None:
        nonlocal line_y
        if line_y is not None and abs(y - line_y) > 0.1 * size * scale:
            gap = (line_y - y) / max(size * scale, 1e-6)
            out.append("\n\n" if gap > 1.75 else "\n")
        line_y = y
        out.append(font.text(data) if font else data.decode("cp1252", "replace"))

    def apart() -> None:
        if out and out[-1] and not out[-1][-1].isspace():
            out.append(" ")

    for value, _ in tokens(content):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value in ("[", "]"):
            continue
        number = [v for v in held if isinstance(v, float)]
        strings = [v for v in held if isinstance(v, bytes)]
        if value == "BT":
            y, scale = 0.0, 1.0
        elif value == "Tf" and held:
            font, size = fonts.get(str(held[0])), abs(number[-1]) if number else size
        elif value == "TL" and number:
            leading = number[-1]
        elif value in ("Td", "TD") and len(number) >= 2:
            y += number[-1] * scale
            if value == "TD":
                leading = -number[-1]
            if not number[-1]:
                apart()
        elif value == "Tm" and len(number) >= 6:
            if number[-1] == y:
                apart()
            y, scale = number[-1], abs(number[-3]) or 1.0
        elif value in ("T*", "'", '"'):
            y -= (leading or size) * scale
        if value in ("Tj", "'", '"') and strings:
            show(strings[-1])
        elif value == "TJ":
            for v in held:
                if isinstance(v, bytes):
                    show(v)
                elif isinstance(v, float) and v < -180:
                    apart()
        held = []
    return "".join(out)


def pdf_pages(content: bytes) -> Iterator[str | Exception]:
    """The text of every page, or what kept it from being read."""
    document = Document(content)
    for page in document.pages():
        try:
            parts = document.get(page.get("Contents"))
            refs = parts if isinstance(parts, list) else [page.get("Contents")]
            yield page_text(b"\n".join(document.stream(r) for r in refs if r is not None), document.fonts(page))
        except Exception as e:  # a page that cannot be read leaves the others
            yield e
