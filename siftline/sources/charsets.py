"""A guess at the charset of bytes that are not UTF-8, by the likelihood of the bytes under models of languages.

Charsets whose decoders, the state machines of the standard library, refuse the bytes are out.  For every single-byte
charset and each language written in it, a model says how likely a byte is after the one before it; it is fitted on a text of
the language as the charset writes it.  Of double-byte charsets, models say how likely characters are.  Only what is beyond
ASCII counts, as the rest is alike in all.  The charset of the likeliest model wins; ties go to the first.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

from siftline.sources.charset_texts import TEXTS

#: Charsets in the order in which ties are decided, and the languages that are written in each.
LANGUAGES = {
    "windows-1252": "en fr de es pt it sv da no fi is nl ca", "windows-1250": "pl cs sk hu ro hr sl", "ISO-8859-2": "pl cs sk hu ro hr sl", "windows-1254": "tr", "windows-1257": "lt lv et",
    "windows-1251": "ru uk bg", "KOI8-R": "ru", "KOI8-U": "uk", "ISO-8859-5": "ru uk bg", "IBM866": "ru uk bg", "windows-1253": "el", "ISO-8859-7": "el",
    "windows-1255": "he", "windows-1256": "ar", "ISO-8859-6": "ar", "windows-874": "th", "windows-1258": "vi",
}
#: Double-byte charsets, their languages, and where their commoner characters are: ranges of first bytes.
DOUBLE = {"Shift_JIS": ("ja", "euc_jp", 0xB0, 0xCF), "EUC-JP": ("ja", "euc_jp", 0xB0, 0xCF), "EUC-KR": ("ko", "euc_kr", 0xB0, 0xC8), "GBK": ("zh", "gb2312", 0xB0, 0xD7), "Big5": ("tw", "big5", 0xA4, 0xC6)}
#: Names of charsets that Python knows by others.
CODECS = {"Shift_JIS": "cp932", "EUC-KR": "cp949", "windows-874": "cp874", "IBM866": "cp866"}
#: What stands between words in any language.
QUOTES, PUNCTUATION = "«»‘’“”„–—…\u00a0", "•·°§©®™€£¥¿¡ªº№、。「」『』・，！？：；（）《》　"
DEFAULT = "windows-1252"
#: Nats that speak against a charset before any byte is seen, by its kind.
AGAINST = {"other Latin": 3.0, "other scripts": 11.0, "double": 9.0}
#: Nats at most by which pairs within ASCII, that tell languages apart but not charsets, speak for a Latin language or against it,
#: and what letters of ASCII beside those of another script speak against a reading.
WITHIN, BESIDE = 10.0, 3.5
#: Nats against other scripts for each doubling of the letters of ASCII for a byte beyond it, and at most.
ASIDE, MOST_ASIDE = 2.0, 8.0
#: The share of marks after any symbol; most of them are quotes.
MARKS = 0.02
#: Counts that what is known of single bytes weighs against those of pairs; shares of texts in capitals and of words that begin with one.
BACKOFF, CAPITALS, TITLES = 4.0, 0.05, 0.2
#: Symbols: letters of ASCII without case, all else in ASCII, and the bytes beyond.
_SYMBOLS = 27 + 128
_SYMBOL = np.array([b - 128 + 27 if b > 127 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0 for b in range(256)])
#: Bytes looked at in one step.
_STEP = 1 << 15


def codec(label: str) -> str:
    return CODECS.get(label, label)


def spelled(text: str, label: str) -> bytes:
    """Text in a single-byte charset; letters that it lacks are taken apart, or left out."""
    out = []
    for char in text:
        try:
            out.append(char.encode(codec(label)))
        except UnicodeEncodeError:
            parts = unicodedata.normalize("NFD", char)
            tones = [p for p in parts if p in "̣̀́̃̉"]
            base = unicodedata.normalize("NFC", "".join(p for p in parts if p not in tones))
            out.append((base + "".join(tones)).encode(codec(label), "ignore"))
    return b"".join(out)


def _reading(label: str) -> list[str]:
    """The character of each byte beyond ASCII; empty where there is none."""
    return [bytes([b]).decode(codec(label), "ignore") for b in range(128, 256)]


def _single(language: str, label: str) -> np.ndarray:
    """Logarithms of the probability of a symbol after another, for all pairs of symbols."""
    text = TEXTS[language]
    pairs = np.zeros((_SYMBOLS, _SYMBOLS))
    for variant, weight in ((text, 1.0), (text.title(), TITLES), (text.upper(), CAPITALS)):
        symbols = _SYMBOL[np.frombuffer(spelled(f" {variant} ", label), np.uint8)]
        np.add.at(pairs, (symbols[:-1], symbols[1:]), weight)
    home = {unicodedata.name(c, "?").split()[0] for c in text if not c.isascii() and c.isalpha()}
    prior = np.full(_SYMBOLS, 1e-3)
    for k, char in enumerate(_reading(label)):
        known = char.isalpha() and unicodedata.name(char, "?").split()[0] in home
        prior[27 + k] = 1e-7 if not char or unicodedata.category(char) == "Cc" else 2e-4 if known or char in QUOTES + PUNCTUATION else 2e-5 if char.isalpha() else 2e-6
    alone = pairs.sum(0) / pairs.sum() + prior
    alone /= alone.sum()
    marks = np.zeros(_SYMBOLS)
    for share, some in ((0.7, QUOTES), (0.3, PUNCTUATION)):
        at = [27 + k for k, c in enumerate(_reading(label)) if c and c in some]
        marks[at] = share / max(1, len(at))
    out = np.log((1 - MARKS) * (pairs + BACKOFF * alone) / (pairs.sum(1, keepdims=True) + BACKOFF) + MARKS * marks)
    if "LATIN" not in home:
        letters = 27 + np.array([k for k, c in enumerate(_reading(label)) if c.isalpha()])
        out[1:27, letters] -= BESIDE
        out[letters, 1:27] -= BESIDE
    return out


def _double(label: str) -> np.ndarray:
    """Logarithms of the probability of each character of the basic plane, in a double-byte charset's language."""
    language, standard, first, last = DOUBLE[label]
    odds = np.full(1 << 16, 1e-7)
    pairs = [(code >> 8, char) for code in range(0x8000, 0x10000) if len(char := code.to_bytes(2, "big").decode(standard, "ignore")) == 1]
    common = [char for lead, char in pairs if first <= lead <= last]
    odds[[ord(char) for _, char in pairs]] = 0.02 / len(pairs)
    odds[[ord(char) for char in common]] = 0.35 / len(common)
    if language == "ja":
        odds[ord("ぁ") : ord("ヿ")] = 0.2 / (ord("ヿ") - ord("ぁ"))
    for char in QUOTES + PUNCTUATION:
        odds[ord(char)] = 0.003
    for char, n in (seen := Counter(c for c in TEXTS[language] if not c.isascii())).items():
        odds[ord(char)] += 0.6 * n / seen.total()
    return np.log(odds)


@lru_cache(maxsize=1)
def models() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of single-byte models: charsets, whether their languages are Latin, nats against them, and log-probabilities by pair of
    symbols; and those of characters."""
    each = [(label, language) for label, languages in LANGUAGES.items() for language in languages.split()]
    latin = {label for label, languages in LANGUAGES.items() if all("LATIN" in unicodedata.name(c, "") for t in languages.split() for c in TEXTS[t] if c.isalpha() and c not in "ªº")}
    against = np.array([0.0 if label == DEFAULT else AGAINST["other Latin" if label in latin else "other scripts"] for label, _ in each])
    table = np.stack([_single(language, label) for label, language in each], axis=2)
    # Within ASCII, only how much likelier a pair is than in Latin languages on average counts, and nothing for other scripts.
    within = table[:27, :27] - np.log(np.exp(table[:27, :27, [label in latin for label, _ in each]]).mean(2, keepdims=True))
    table[:27, :27] = within * [label in latin for label, _ in each]
    table = table.reshape(_SYMBOLS * _SYMBOLS, -1).astype(np.float32)
    return [label for label, _ in each], np.array([label in latin for label, _ in each]), against, table, {label: _double(label) for label in DOUBLE}


def _singles(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of each of data under each single-byte model; and nats against scripts other than Latin.  The bytes of the
    whole batch are looked at in steps, wherever texts begin and end, so what is held besides follows neither."""
    _, latin, against, table, _ = models()
    out, within = np.tile(-against, (len(data), 1)), np.zeros((len(data), len(against)))
    letters, high = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    last = 0
    for at in range(0, len(joined), _STEP):
        symbols = _SYMBOL[joined[at : at + _STEP]]
        before = np.concatenate([[last], symbols[:-1]])
        owner = np.searchsorted(ends, np.arange(at, at + len(symbols)), "right")
        beyond = (before > 26) | (symbols > 26)
        for total, some in ((out, np.flatnonzero(beyond)), (within, np.flatnonzero(~beyond & (before + symbols > 0)))):
            if len(some):
                first = np.flatnonzero(np.diff(owner[some], prepend=-1))
                total[owner[some[first]]] += np.add.reduceat(table[before[some] * _SYMBOLS + symbols[some]], first, axis=0, dtype=np.float64)
        for total, test in ((letters, (symbols > 0) & (symbols < 27)), (high, symbols > 26)):
            found = np.bincount(owner[test] - owner[0])
            total[owner[0] : owner[0] + len(found)] += found
        last = symbols[-1]
    aside = np.minimum(MOST_ASIDE, ASIDE * np.log2(1 + letters / np.maximum(high, 1)))
    return out + np.clip(within, -WITHIN, WITHIN) - aside[:, None] * ~latin, aside


def _read(data: bytes, label: str) -> str | None:
    """The bytes as a charset reads them, but for a character cut off at the end; null where it can't."""
    for cut in (0, 1):
        try:
            return data[: len(data) - cut].decode(codec(label))
        except UnicodeDecodeError as e:
            if e.start < len(data) - 1 or not len(data):
                return None
    return None


def _characters(text: str, odds: np.ndarray) -> float:
    """Log-likelihood of a double-byte text; letters of ASCII beside its characters are rare."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0xFFFF)
    beyond = codes > 127
    letters = ~beyond & np.isin(codes | 32, np.arange(97, 123))
    beside = (beyond[1:] & letters[:-1]) | (letters[1:] & beyond[:-1])
    return float(odds[codes[beyond]].sum() + np.log(0.05) * beside.sum() + np.log(0.3) * ((beyond[1:] != beyond[:-1]) & ~beside).sum())


def guessed_all(data: list[bytes]) -> list[str]:
    """The charset of the likeliest model for each; the default where all is ASCII."""
    labels, *_, double = models()
    found = []
    if not data:
        return found
    for one, scores, aside in zip(data, *_singles(data)):
        best, label = -np.inf, DEFAULT
        possible = {name: name == DEFAULT or _read(one, name) is not None for name in LANGUAGES}
        for name, score in zip(labels, scores):
            if score > best + 1e-6 and possible[name]:
                best, label = score, name
        for name, odds in double.items():
            text = _read(one, name)
            if text is not None and not text.isascii() and (score := _characters(text, odds) - AGAINST["double"] - aside) > best + 1e-6:
                best, label = score, name
        if label in LANGUAGES and label != DEFAULT:  # the first of charsets that agree on these bytes
            text, languages = _read(one, label), set(LANGUAGES[label].split())
            label = next(name for name in LANGUAGES if possible[name] and name != DEFAULT and languages & set(LANGUAGES[name].split()) and _read(one, name) == text)
        found.append(DEFAULT if one.isascii() else label)
    return found


def guessed(data: bytes) -> str:
    return guessed_all([data])[0]
