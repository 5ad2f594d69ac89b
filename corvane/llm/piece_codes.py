"""The pieces that `alignment.pieces` finds sentence by sentence, found in many texts at once and given as whole numbers (problem 7).

Texts lie one behind the other in one array of characters. Sentences, words, numbers and pairs of characters are found by comparing neighbours in
it, so that Python does nothing for each character or piece. A code says what its piece is, without a loss: a pair of characters by both, a word
of up to MOST_LETTERS letters from a to z by its letters, a number of up to MOST_DIGITS digits and points by these. Other words and longer numbers
are told apart by a table of those met so far, and their codes hold until it is cleared.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from corvane.llm.leakage import SPACELESS

KNOWN, LETTER, PAIRED, DIGIT, INK, ALNUM, END, STOP = 128, 1, 2, 4, 8, 16, 32, 64
KIND = LETTER | PAIRED | DIGIT
LETTERS, NUMBERS, OTHERS = 1 << 60, 2 << 60, 3 << 60  # beside pairs of characters
LETTER_BITS, MOST_LETTERS, DIGIT_BITS, MOST_DIGITS, CHARACTER_BITS = 5, 12, 4, 15, 21
SLICE = 1 << 18  # characters whose pieces are found at once; what they take grows with long texts no more than the texts do
HYPHENS = (0x2D, 0xAD, 0x2010, 0x2011)
BETWEEN = "\x1f"  # between texts: white space that is no part of a piece and divides no word


def traits_of(ch: str) -> int:
    out = KNOWN | (0 if ch.isspace() else INK) | (ALNUM if ch.isalnum() else 0)
    if ch in "。！？":
        out |= END
    elif ch in ".!?":
        out |= STOP
    elif "0" <= ch <= "9":
        out |= DIGIT
    elif re.match(f"[{SPACELESS}]", ch):
        out |= PAIRED
    elif "0" < ch < "\U00020000" and unicodedata.category(ch)[0] in "LM":
        out |= LETTER
    return out


def joined(values: np.ndarray, sizes: np.ndarray, bits: int, most: int) -> np.ndarray:
    """One whole number for each run of so many values, which are below 1 << bits; right for runs of up to `most`."""
    starts = np.cumsum(sizes) - sizes
    places = np.arange(len(values)) - np.repeat(starts, sizes)
    return np.add.reduceat(values.astype(np.int64) << bits * np.minimum(places, most - 1), starts)


class PieceCodes:
    def __init__(self):
        self.traits = np.zeros(0x110000, dtype=np.uint8)  # of the characters met so far
        self.clear()

    def clear(self) -> None:
        """Forget the words that have no code of their own, whose codes no longer hold."""
        self.places: dict[str, int] = {}
        self.names: list[str] = []

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, sentence, code, beyond) of all pieces in their order: the text's number, the sentence's among all texts, the piece's code and
        whether it begins beyond the Latin script."""
        low = [t.lower() for t in texts]
        chars = np.frombuffer("".join(x for t in low for x in (t, BETWEEN)).encode("utf-32-le"), dtype=np.uint32)
        if not len(chars):
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=bool),)
        sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
        traits = self.traits[chars]
        if not traits.all():
            for c in np.unique(chars[traits == 0]).tolist():
                self.traits[c] = traits_of(chr(c))
            traits = self.traits[chars]
        part, text, sentence = self.sentences(traits, np.cumsum(sizes) - sizes)

        line_ends = np.flatnonzero(chars == 10)
        divided = line_ends[np.isin(chars[line_ends - 1], HYPHENS)]
        if len(divided):  # words divided at the end of a line are put together
            keep = np.ones(len(chars), dtype=bool)
            keep[divided] = keep[divided - 1] = False
            chars, traits, part = chars[keep], traits[keep], part[keep]

        at, codes = [], []
        cuts = self.cuts(chars, traits)
        for i, j in zip(cuts, cuts[1:]):
            found = self.codes(chars[i:j], traits[i:j])
            at.append(np.flatnonzero(found))
            codes.append(found[at[-1]])
            at[-1] += i
        at = np.concatenate(at)
        part = part[at]
        return text[part], sentence[part], np.concatenate(codes), chars[at] >= 0x370

    @staticmethod
    def cuts(chars: np.ndarray, traits: np.ndarray) -> list[int]:
        """From 0 to the end in steps of about SLICE, each behind a character that is in no piece."""
        cuts = [0]
        if len(chars) > 2 * SLICE:
            outside = np.flatnonzero((traits & KIND == 0) & (chars != ord(",")) & (chars != ord("."))) + 1
            cuts += np.unique(outside[np.searchsorted(outside, np.arange(SLICE, len(chars), SLICE))]).tolist()
        return cuts if cuts[-1] == len(chars) else [*cuts, len(chars)]

    @staticmethod
    def sentences(traits: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The part of each character, as ends of sentences divide the texts that begin at these places; the text and the sentence of each part."""
        ends = (traits & END) > 0
        ends[:-1] |= (traits[:-1] & STOP > 0) & (traits[1:] & INK == 0)
        begins = np.concatenate(([True], ends[:-1]))
        begins[texts] = True
        starts = np.flatnonzero(begins)
        own = np.bitwise_or.reduceat(traits, starts)
        text = np.searchsorted(texts, starts, "right") - 1
        opens = (own & ALNUM) > 0  # what has neither letters nor digits belongs to the sentence before
        inked = np.flatnonzero(own & INK)
        opens[inked[np.diff(text[inked], prepend=-1) != 0]] = True
        return np.cumsum(begins, dtype=np.int32) - 1, text, np.cumsum(opens) - 1

    def codes(self, chars: np.ndarray, traits: np.ndarray) -> np.ndarray:
        """The code of each piece, where it begins, and 0 elsewhere."""
        codes = np.zeros(len(chars), dtype=np.int64)
        kind = traits & KIND
        marks = np.flatnonzero((chars == ord(",")) | (chars == ord(".")))
        kind[marks[(kind[marks - 1] == DIGIT) & (kind[marks + 1] == DIGIT)]] = DIGIT
        changes = np.diff(kind, prepend=np.uint8(0)) != 0
        run = np.cumsum(changes, dtype=np.int32)

        at = np.flatnonzero((kind == PAIRED) & (traits & ALNUM > 0))
        c, same = chars[at].astype(np.int64), np.diff(run[at]) == 0
        codes[at[:-1][same]] = c[:-1][same] << CHARACTER_BITS | c[1:][same]
        alone = at[~(np.concatenate((same, [False])) | np.concatenate(([False], same)))[: len(at)]]
        codes[alone] = chars[alone]

        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for which, tag, bits, most in ((LETTER, LETTERS, LETTER_BITS, MOST_LETTERS), (DIGIT, NUMBERS, DIGIT_BITS, MOST_DIGITS)):
            own = kind == which
            starts = np.flatnonzero(own & changes)
            if not len(starts):
                continue
            own = np.flatnonzero(own & (chars != ord(","))) if which == DIGIT else np.flatnonzero(own)
            c, sizes = chars[own].astype(np.int64), np.diff(np.searchsorted(own, starts), append=len(own))
            short = sizes <= most
            if which == LETTER:
                short &= np.logical_and.reduceat((c >= ord("a")) & (c <= ord("z")), np.cumsum(sizes) - sizes)
                values = c - (ord("a") - 1)
            else:
                values = np.where(c == ord("."), 11, c - (ord("0") - 1))
            codes[starts[short]] = joined(values, sizes, bits, most)[short] | tag
            if not short.all():
                rest.append(starts[~short])
        if rest:
            whole, ends = chars.tobytes().decode("utf-32-le"), np.append(np.flatnonzero(changes), len(chars))
            for starts in rest:
                for i, j in zip(starts.tolist(), ends[run[starts]].tolist()):
                    codes[i] = OTHERS | self.place(whole[i:j].replace(",", ""))
        return codes

    def place(self, word: str) -> int:
        found = self.places.setdefault(word, len(self.names))
        if found == len(self.names):
            self.names.append(word)
        return found

    def spelled(self, codes: np.ndarray) -> list[str]:
        """The pieces of these codes."""
        out = np.empty(len(codes), dtype=object)
        tags = codes & OTHERS
        for tag, bits, most, signs in ((LETTERS, LETTER_BITS, MOST_LETTERS, b"\0abcdefghijklmnopqrstuvwxyz"), (NUMBERS, DIGIT_BITS, MOST_DIGITS, b"\x000123456789.")):
            own = np.flatnonzero(tags == tag)
            values = codes[own, None] >> np.arange(0, bits * most, bits) & ((1 << bits) - 1)
            out[own] = np.frombuffer(signs, dtype=np.uint8)[values].view(f"S{most}").ravel().astype(str)
        for i in np.flatnonzero(tags == OTHERS).tolist():
            out[i] = self.names[codes[i] - OTHERS]
        for i in np.flatnonzero(tags == 0).tolist():
            first, second = divmod(int(codes[i]), 1 << CHARACTER_BITS)
            out[i] = chr(first) + chr(second) if first else chr(second)
        return out.tolist()
