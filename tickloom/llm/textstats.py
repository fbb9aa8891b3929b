"""Statistics of many texts at once, as array arithmetic over code points.

A block of texts is one array of code points with a line break after each text. Every character has a kind (looked up in a
table made from the Unicode categories), words are runs of one kind of letters, lines end at line breaks, and all counts are
sums between borders of words, lines or texts. Words are compared by a 64-bit polynomial hash taken from prefix sums, so no
string is made for any of them.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: The statistics, in the order of the vectors. Those "of the text" weigh a line by its characters.
STATISTICS = [
    "log_words", "mean_word_length", "word_length_spread", "symbol_ratio", "digit_ratio", "vowel_ratio", "capital_words", "common_words", "repetition",
    "punctuated_lines", "punctuated_text", "log_line_length", "log_words_per_sentence", "separators_per_word", "column_agreement", "marked_starts", "digit_ends",
]
#: Characters of a block of texts; a longer text is a block by itself.
BLOCK_CHARS = 1_000_000
#: Lags at which words are compared for repetition, each at most a fifth of a text's words.
LAGS = 8

SYMBOL, BLANK, BREAK, DIGIT, SOFT, END, SEPARATOR, BAR = range(8)
LETTER, HIRAGANA, KATAKANA, HAN = range(8, 12)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _hashes(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each stretch of codes, wherever it lies: differences of prefix sums, shifted back to the front."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    power, back = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(low), b, np.uint64)]) for b in (_BASE, inverse))
    upto = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], dtype=np.uint64)]
    return (upto[stop] - upto[start]) * back[start]


class Alphabet:
    """Per code point of the basic plane: kind, lower case, is upper case, is a vowel. Others are symbols."""

    def __init__(self):
        n = 0x10000
        kind, self.lower, self.upper = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.zeros(n, bool)
        for c in range(n):
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat[0] in "LM":
                kind[c] = HIRAGANA if 0x3040 <= c < 0x30A0 else KATAKANA if 0x30A0 <= c < 0x3100 else HAN if 0x3400 <= c < 0xA000 else LETTER
                self.upper[c] = cat in ("Lu", "Lt")
                if cat in ("Lu", "Lt") and len(low := ch.lower()) == 1:
                    self.lower[c] = ord(low)
            elif cat == "Nd":
                kind[c] = DIGIT
            elif cat in ("Zs", "Cc"):
                kind[c] = BLANK
            elif cat in ("Pi", "Pf", "Ps", "Pe", "Pd"):
                kind[c] = SOFT
        for chars, k in (("\n", BREAK), (".!?…。！？", END), (",;:、，；：・·•/", SEPARATOR), ("|│¦\t", BAR), ("'\"’-", SOFT), ("[]{}<>", SYMBOL)):
            for ch in chars:
                kind[ord(ch)] = k
        self.kind, self.vowel = kind, np.zeros(n, bool)
        for c in np.flatnonzero((kind == LETTER) & (np.arange(n) < 0x530)):
            self.vowel[c] = unicodedata.normalize("NFD", chr(self.lower[c]))[0] in "aeiouyæœøαεηιουωаеиоуыэюяєіїё"


def _words(kind: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of words; an apostrophe or hyphen between two letters is part of the word."""
    k = np.where(kind >= LETTER, kind, 0)
    if len(k) > 2:
        inner = (k[:-2] == LETTER) & (k[2:] == LETTER) & np.isin(code[1:-1], [0x27, 0x2019, 0x2D])
        k[1:-1][inner] = LETTER
    edge = np.flatnonzero(np.diff(np.r_[np.uint8(0), k, np.uint8(0)]))
    at = np.r_[edge, len(k)]
    start, stop = at[:-1], at[1:]
    real = (start < len(k)) & (k[np.minimum(start, len(k) - 1)] > 0)
    return start[real], stop[real]


class CommonWords:
    """Which language has which common words, by hash."""

    def __init__(self, common: dict[str, frozenset]):
        self.languages = sorted(common)
        pairs = [(w.lower(), i) for i, lang in enumerate(self.languages) for w in common[lang] if w]
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w, _ in pairs]
        ends = np.cumsum([len(c) for c in codes]) if codes else np.zeros(0, int)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        h = _hashes(flat, np.r_[0, ends[:-1]] if len(ends) else ends, ends) if codes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.of = h[order], np.array([i for _, i in pairs], dtype=np.int64)[order] if pairs else np.zeros(0, np.int64)

    def counts(self, h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """(texts, languages): how many of the words are common ones of each language."""
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        k = max(len(self.languages), 1)
        return np.bincount(np.repeat(text, n) * k + self.of[at], minlength=texts * k).reshape(texts, k)


def _per(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=n).astype(float)


def _columns(kind: np.ndarray, code: np.ndarray, line: np.ndarray, lines: int, follows: np.ndarray) -> np.ndarray:
    """Lines that have as many dividers of some sort as the line before or after: bars, tabs, tight commas or semicolons, wide gaps."""
    after = np.r_[kind[1:], BREAK]
    wide = (code == 0x20) & np.r_[False, code[:-1] != 0x20] & np.r_[code[1:] == 0x20, False] & np.r_[False, kind[:-1] != BREAK]
    sorts = [kind == BAR, (code == 0x2C) & (after != BLANK), (code == 0x3B) & (after != BLANK), wide]
    agree = np.zeros(lines, bool)
    for s in sorts:
        if not s.any():
            continue
        n = np.bincount(line[s], minlength=lines)
        same = follows & (n[1:] == n[:-1]) & (n[1:] > 0)
        agree[1:] |= same
        agree[:-1] |= same
    return agree


def _block(texts: list[str], tags: list[str | None], common: CommonWords, letters_of: Alphabet) -> tuple[list[str], np.ndarray, np.ndarray]:
    t = len(texts)
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, t)
    text = np.repeat(np.arange(t), sizes)
    kinds, lower, upper, vowel = letters_of.kind, letters_of.lower, letters_of.upper, letters_of.vowel
    known = code < 0x10000
    bounded = np.where(known, code, 0)
    kind = np.where(known, kinds[bounded], SYMBOL).astype(np.uint8)
    kind[code == 0] = BLANK
    # words
    start, stop = _words(kind, code)
    of, length = text[start], (stop - start).astype(float)
    h = _hashes(lower[bounded], start, stop)
    n = _per(of, t)
    some = np.maximum(n, 1)
    hits = common.counts(h, of, t)
    language, hit = [], np.zeros(t)
    place = {lang: i for i, lang in enumerate(common.languages)}
    best = hits.argmax(axis=1)
    for i, tag in enumerate(tags):
        given = (tag or "").strip().lower().replace("_", "-").split("-")[0]
        own, top = (hits[i, place[given]] if given in place else 0), hits[i, best[i]]
        if place and top >= 3 and top > 1.3 * own or given not in place and top > 0:
            given = common.languages[best[i]]
        language.append(given if given in place else "und")
        hit[i] = hits[i, place[given]] if given in place else 0
    repetition = np.zeros(t)
    for lag in range(1, LAGS + 1):
        same = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        fits = (n >= 12) & (lag <= n / 5)
        repetition = np.maximum(repetition, np.where(fits, _per(of[lag:][same], t) / np.maximum(n - lag, 1), 0))
    mean = _per(of, t, length) / some
    spread = np.sqrt(np.maximum(_per(of, t, length**2) / some - mean**2, 0))
    # characters
    count = lambda mask: _per(text[mask], t)
    letters, digits = count(kind >= LETTER), count(kind == DIGIT)
    visible = np.maximum(count((kind != BLANK) & (kind != BREAK) & (code != 0x09)), 1)
    vowels = count(vowel[bounded] & known) / np.maximum(count(kind == LETTER), 1)
    capitals = _per(of, t, upper[bounded[start]]) / some
    ended = kind == END
    ended[:-1] &= kind[1:] != END
    ended[:-1] &= (kind[1:] != DIGIT) & (kind[1:] < LETTER) | (code[:-1] > 0x3000)
    ends = count(ended)
    separators = count((kind == SEPARATOR) | (kind == BAR))
    # lines that are not blank
    line = np.cumsum(kind == BREAK) - (kind == BREAK)
    lines = int(line[-1]) + 1
    shown = np.flatnonzero((kind != BLANK) & (kind != BREAK))
    on = line[shown]
    width = np.bincount(on, minlength=lines)
    heads = np.r_[True, on[1:] != on[:-1]] if len(on) else np.zeros(0, bool)
    first, last, rows = shown[heads], shown[np.r_[heads[1:], True]] if len(on) else shown, on[heads]
    number = np.full(lines, -1)
    number[rows] = np.arange(len(rows))
    line_text = text[first]
    size = (last - first + 1).astype(float)
    follows = line_text[1:] == line_text[:-1]
    m = len(rows)
    inside = number[line] >= 0
    agree = _columns(kind[inside], code[inside], number[line][inside], m, follows) if m else np.zeros(0, bool)
    # a closing quote or bracket does not hide the mark before it
    before = np.where(last > first, last - 1, last)
    end_kind = np.where(kind[last] == SOFT, np.where(code[last] == 0x2D, SOFT, kind[before]), kind[last])
    punctuated = (end_kind == END) | np.isin(code[last], [0x3A, 0x3B, 0xFF1A, 0xFF1B])
    marked = (kind[first] < LETTER) & (kind[first] != SOFT) | (code[first] == 0x2D) | (code[first] == 0x28)
    closing = np.where(kind[last] == SOFT, kind[before], kind[last])
    chars = np.maximum(_per(line_text, t, size), 1)
    share = lambda mask: _per(line_text[mask], t, size[mask]) / chars
    v = np.column_stack([
        np.log1p(n), np.minimum(mean, 40), np.minimum(spread, 20), np.maximum(visible - letters - digits - ends, 0) / visible, digits / visible, vowels, capitals, hit / some, repetition,
        _per(line_text[punctuated], t) / np.maximum(_per(line_text, t), 1), share(punctuated), _per(line_text, t, size * np.log1p(size)) / chars, np.log1p(n / (1 + ends)), np.minimum(separators / some, 5),
        share(agree), share(marked), share(closing == DIGIT),
    ])
    return language, n.astype(np.int64), v


def measure(texts: list[str], tags: list[str | None], common: CommonWords, alphabet: Alphabet) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, number of words and vector of statistics of each text (which has a character other than blanks).

    The language is the one with the most common words, if there are at least three of them and clearly more than of the tagged one; the
    tag, without case and region, decides otherwise.
    """
    language, n, v = [], [np.zeros(0, np.int64)], [np.zeros((0, len(STATISTICS)))]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_CHARS):
            size += len(texts[j])
            j += 1
        a, b, c = _block(texts[i:j], tags[i:j], common, alphabet)
        language += a
        n.append(b)
        v.append(c)
        i = j
    return language, np.concatenate(n), np.concatenate(v)
