"""Sentences and tokens, as several operators of this subpackage need them."""

from __future__ import annotations

import re

SENTENCE_END = re.compile(r"[。！？]|[.!?](?=\s|$)")
WORD = re.compile("[a-zà-ɏ]+(?:['’][a-z]+)?|[0-9]+(?:[.,:/-][0-9]+)*|[㐀-鿿]|%")


def sentence_spans(text: str | None, paragraphs: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without outer white space: it ends at 。！？, or at .!? before white space or the end of the text.

    What has neither letters nor digits, such as a closing quote, belongs to the sentence before. paragraphs: an empty line ends a sentence too.
    """
    if not text:
        return []
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if paragraphs:
        ends = sorted({*ends, *(m.start() for m in re.finditer(r"\n\s*\n", text))})
    out, at = [], 0
    for e in (*ends, len(text)):
        piece = text[at:e]
        if body := piece.strip():
            start = at + piece.index(body[0])
            if out and not any(map(str.isalnum, body)):
                out[-1] = (out[-1][0], start + len(body))
            else:
                out.append((start, start + len(body)))
        at = e
    return out


def sentences(text: str | None, paragraphs: bool = False) -> list[str]:
    if text and not paragraphs and ((m := SENTENCE_END.search(text)) is None or m.end() == len(text)):
        return [s] if (s := text.strip()) else []
    return [text[a:b] for a, b in sentence_spans(text, paragraphs)]


def words(sentence: str) -> list[str]:
    """Lower-case words, numbers as they are, Chinese characters one by one."""
    return WORD.findall(sentence.lower())
