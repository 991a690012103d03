"""Main content of crawled pages: the bytes decoded by what they hold, and the paragraphs without menus, link lists and footers."""

from __future__ import annotations

import html
import re

_BLOCK = re.compile(r"<(p|div)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_SKIP = re.compile(r"<(nav|footer|ul|aside|script|style|header)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^>]*>")
_HIGH = re.compile(rb"[\x80-\xff]+")


def decode(raw: bytes) -> str:
    """The page as text: UTF-8 if its bytes say so, else Shift-JIS, windows-1251 or windows-1252 by what they hold; the declared charset is not asked."""
    text = raw.decode("utf-8", "replace")
    bad = text.count("�")
    if not bad:
        return text
    runs = _HIGH.findall(raw)
    high = sum(map(len, runs))
    if bad * 4 <= sum(c > "\x7f" for c in text) - bad:
        return text
    try:
        ja = raw.decode("shift_jis")
        if sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in ja) * 3 > high:
            return ja
    except UnicodeDecodeError:
        pass
    letters = sum(65 <= (c | 32) - 32 <= 90 for c in re.sub(rb"<[^>]*>", b"", raw))
    return raw.decode("cp1251" if high > letters else "cp1252", "replace")


def paragraphs(raw: bytes | None, text: str | None) -> list[str]:
    """The paragraphs of the main content; a page whose text is NULL or blank has none.

    Without bytes that hold paragraphs the lines of the text stand in for them.
    """
    if text is None or not text.strip():
        return []
    blocks = []
    if raw:
        page = _SKIP.sub(" ", decode(raw))
        blocks = [html.unescape(_TAG.sub(" ", m[1])).strip() for m in _BLOCK.findall(page)]
    return [b for b in blocks if b] if raw else [x for x in text.split("\n") if x.count(" ") >= 4]

