"""Text of documents: office files, archives, rich text and PDF."""

from __future__ import annotations

import io
import re
import subprocess
import zipfile
from collections.abc import Callable
from xml.parsers import expat

#: Entries, bytes of an entry and of text, and seconds for a PDF.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_TEXT_BYTES, PDF_SECONDS = 1024, 4 << 20, 16 << 20, 30
#: Entries that hold the text of each type, and types of text inside archives.
ENTRIES = {"docx": ("word/document.xml",), "xlsx": ("xl/sharedStrings.xml", "xl/comments1.xml"), "odt": ("content.xml",), "ods": ("content.xml",), "odp": ("content.xml",)}
TEXT_TYPES = frozenset("bash c conf cpp css csv fish go h hpp htm html ini java js json log md py rs sh toml ts tsv txt xml yaml yml zsh".split())
#: Rich-text groups that hold no text.
_NO_TEXT = frozenset("colortbl fonttbl footer header info object pict stylesheet".split())


class ExtractError(Exception):
    """A document that can't be read, or is beyond the limits."""


def xml_text(data: bytes) -> str:
    """Text and CDATA, entities resolved, a space after each piece."""
    out: list[str] = []
    held: list[str] = []

    def flush(*_):
        if held:
            out.append("".join(held) + " ")
            held.clear()

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = p.EndElementHandler = flush
    p.CharacterDataHandler = held.append
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise ExtractError(str(e)) from e
    flush()
    return "".join(out)


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as f:
        data = f.read(MOST_ENTRY_BYTES + 1)
    if len(data) > MOST_ENTRY_BYTES:
        raise ExtractError(f"{name} is too large")
    return data


def _office(names: Callable[[list[str]], list[str]]) -> Callable[[bytes], str]:
    def text(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            listed = z.namelist()
            if len(listed) > MOST_ENTRIES:
                raise ExtractError("too many entries")
            return "".join(xml_text(_entry(z, n)) + "\n" for n in names(listed))

    return text


def archive_text(content: bytes) -> str:
    """The names of an archive's entries, then the texts of those that are text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if len(names) > MOST_ENTRIES:
            raise ExtractError("too many entries")
        out = ["# Entries", *names, "# Contents"]
        for n in names:
            if n.rpartition(".")[2].lower() in TEXT_TYPES and "." in n:
                try:
                    out += [f"--- {n} ---", _entry(z, n).decode("utf-8", "replace")]
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
                    continue
    return "\n".join(out) + "\n"


def rich_text(content: bytes) -> str:
    """Plain text of RTF: control words go, paragraphs and lines end lines, tabs stay, surrogates are joined."""
    s = content.decode("latin-1")
    out: list[str] = []
    skip = [False]
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", s):
        code, word, number, sign, brace, plain = m[1], m[2], m[3], m[4], m[5], m[6]
        if brace == "{":
            skip.append(skip[-1])
        elif brace == "}":
            if len(skip) > 1:
                skip.pop()
        elif sign == "*" or word in _NO_TEXT:
            skip[-1] = True
        elif skip[-1]:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("windows-1252", "replace"))
        elif word in ("par", "line", "lbr"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif plain:
            out.append(plain)
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def rich_text_of(text: str) -> str:
    """RTF, in ASCII, whose plain text is a text: escapes of UTF-16 units stand for all other characters."""

    def escaped(m: re.Match) -> str:
        c = m[0]
        if c == "\n":
            return r"\par "
        if c == "\r":
            return r"\'0d"
        if c < "\x80":
            return "\\" + c
        units = c.encode("utf-16-le", "surrogatepass")
        return "".join(rf"\u{int.from_bytes(units[i : i + 2], 'little', signed=True)} " for i in range(0, len(units), 2))

    return r"{\rtf1\uc0{\fonttbl{\f0 Arial;}}" + re.sub(r"[\\{}\r\n]|[^\x00-\x7F]", escaped, text) + "}"


def archive(entries: dict[str, str]) -> bytes:
    """Texts as an archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def office_file(text: str) -> bytes:
    """A text as a word processor's file of one paragraph; characters that XML has no place for are left out."""
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)
    escaped = clean.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return archive({"word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="x"><w:p>{escaped}</w:p></w:document>'})


def pdf_text(content: bytes) -> str:
    """By the pdftotext program, if there is one."""
    try:
        done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, timeout=PDF_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError) as e:
        raise ExtractError(str(e)) from e
    return done.stdout.decode("utf-8", "replace")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    **{kind: _office(lambda listed, want=want: [n for n in want if n in listed]) for kind, want in ENTRIES.items()},
    "pptx": _office(lambda listed: sorted(n for n in listed if re.fullmatch(r"ppt/slides/[^/]+\.xml", n))),
    "zip": archive_text,
    "rtf": rich_text,
    "pdf": pdf_text,
}


def extracted(extension: str | None, content: bytes) -> str | None:
    """The text of a document; null if its type is none of EXTRACTORS.  Raises ExtractError."""
    read = EXTRACTORS.get((extension or "").lower())
    if read is None:
        return None
    try:
        text = read(content)
    except (zipfile.BadZipFile, KeyError, RuntimeError, NotImplementedError, ValueError) as e:
        raise ExtractError(str(e)) from e
    if len(text.encode("utf-8", "replace")) > MOST_TEXT_BYTES:
        raise ExtractError("too much text")
    return text
