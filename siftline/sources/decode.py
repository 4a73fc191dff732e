"""Bytes to text: byte order marks, strict UTF-8, then a guess that never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.sources import charsets

#: Marks in the order in which they are tried, and the label of each.
MARKS = ((b"\xef\xbb\xbf", "UTF-8 BOM"), (b"\xff\xfe\x00\x00", "UTF-32 LE"), (b"\x00\x00\xfe\xff", "UTF-32 BE"), (b"\xff\xfe", "UTF-16 LE"), (b"\xfe\xff", "UTF-16 BE"))
_CODECS = {"UTF-8": "utf-8", "UTF-8 BOM": "utf-8-sig", "UTF-16 LE": "utf-16-le", "UTF-16 BE": "utf-16-be"}
GUESSED_FROM = 64 * 1024


def mark_label(content: Column) -> Column:
    """The encoding that a byte order mark names; UTF-8 without any."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for mark, label in MARKS:
        test = F.startswith(head, F.lit(mark.hex().upper()))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("UTF-8")


def _certain(data: bytes) -> tuple[str, str] | None:
    """(text, label) by a mark, as UTF-8 or by escape sequences; null where only a guess is left."""
    for mark, label in MARKS:
        if data.startswith(mark):
            if label.startswith("UTF-32"):
                return data.decode("utf-8", "replace"), label
            return data[len(mark) :].decode(_CODECS[label].replace("-sig", ""), "replace"), label
    try:
        return data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        pass
    if b"\x1b$" in data[:GUESSED_FROM] or b"\x1b(J" in data[:GUESSED_FROM]:
        try:
            return data.decode("iso2022_jp"), "ISO-2022-JP"
        except UnicodeDecodeError:
            pass
    return None


def decoded_all(data: list[bytes | None]) -> list[tuple[str | None, str | None]]:
    """(text, label) of each; those that need a guess are guessed together.  UTF-32 is labelled, and read as UTF-8 with
    replacements; null gives nulls."""
    out = [(None, None) if d is None else _certain(d) for d in data]
    open_ = [k for k, found in enumerate(out) if found is None]
    for k, label in zip(open_, charsets.guessed_all([data[k][:GUESSED_FROM] for k in open_])):
        out[k] = data[k].decode(charsets.codec(label), "replace"), label
    return out


def decoded(data: bytes) -> tuple[str, str]:
    return decoded_all([data])[0]


def encoded(text: str, label: str) -> bytes:
    """Text in its file's encoding again; characters that it lacks become numeric references."""
    if label.startswith("UTF-32"):
        raise ValueError("UTF-32 files are not written back")
    if label in ("UTF-16 LE", "UTF-16 BE"):
        return dict((name, mark) for mark, name in MARKS)[label] + text.encode(_CODECS[label])
    return text.encode(_CODECS.get(label) or charsets.codec(label), "xmlcharrefreplace")
