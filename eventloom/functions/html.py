"""Readable text of one HTML page, with a tolerant parser from the standard library.

This is the only per-row Python in the text jobs; everything that a regular
expression can do is left to Catalyst (see ``operators.pagetext``).
"""

from __future__ import annotations

from html.entities import html5
from collections import Counter
from html.parser import HTMLParser

# Subtrees that carry no content, tags that never have content, and
# tags whose strings are not page text.
DROPPED = {"script", "style", "nav", "footer", "noscript", "svg", "img"}
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
    "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
}
SILENT = {"template", "rt", "rp"}
COUNTED = ["script", "style", "nav", "footer", "header", "noscript", "svg", "img"]


class PageText(HTMLParser):
    """Collects text pieces together with the places they belong to."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []  # names of the open elements, outermost first
        # Counts over the open elements, so that no tag or text walks through all of them.
        self.of: Counter[str] = Counter()
        self.dropped = self.silent = 0
        self.depth: dict[str, int] = {}  # first kept <main>, <body>: its stack depth while open
        self.seen: set[str] = set()
        self.pieces: list[tuple[str, bool, bool]] = []  # text, inside main, inside body
        self.link: tuple[int, str, list[str], bool, bool] | None = None
        self.buffer: list[str] = []
        self.counts = dict.fromkeys(COUNTED, 0)
        self.found_main = False

    # -- text -----------------------------------------------------------------
    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text or self.dropped or self.silent:
            return
        if self.link is not None:
            self.link[2].append(text)
        else:
            self.pieces.append((text, "main" in self.depth, "body" in self.depth))

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_entityref(self, name: str) -> None:
        self.buffer.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        number = int(name[1:], 16) if name[:1] in "xX" else int(name)
        if 0x80 <= number < 0xA0:  # pages that number their quotes and dashes the Windows way
            self.buffer.append(bytes([number]).decode("windows-1252", "ignore") or chr(number))
        elif number >= 0x110000 or 0xD800 <= number < 0xE000:
            self.buffer.append("\N{REPLACEMENT CHARACTER}")
        else:
            self.buffer.append(chr(number))

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data.upper().startswith("CDATA["):
            self.buffer.append(data[6:])
            self.flush()

    def count(self, tag: str, by: int) -> None:
        self.of[tag] += by
        self.dropped += by * (tag in DROPPED)
        self.silent += by * (tag in SILENT)

    # -- structure ------------------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        if tag in self.counts:
            self.counts[tag] += 1
        self.found_main |= tag == "main"
        self.open.append(tag)
        self.count(tag, 1)
        kept = self.link is None and not self.dropped
        if tag in ("main", "body") and kept and tag not in self.seen:
            self.seen.add(tag)
            self.depth[tag] = len(self.open)
        if tag == "a" and kept:
            href = (dict(attrs).get("href") or "").strip()
            if href and not href.startswith(("#", "javascript")):
                self.link = (len(self.open), href, [], "main" in self.depth, "body" in self.depth)
        if tag in VOID:
            self.close_innermost()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in VOID or not self.of[tag]:
            return
        while self.open[-1] != tag:
            self.close_innermost()
        self.close_innermost()

    def close_innermost(self) -> None:
        level = len(self.open)
        self.count(self.open.pop(), -1)
        if self.link is not None and self.link[0] == level:
            _, href, texts, in_main, in_body = self.link
            self.pieces.append((f"{''.join(texts)} [{href}]".strip(), in_main, in_body))
            self.link = None
        for name in ("main", "body"):
            if self.depth.get(name) == level:
                del self.depth[name]

    def finish(self) -> str:
        self.close()
        self.flush()
        while self.open:
            self.close_innermost()
        if "main" in self.seen:
            chosen = [text for text, in_main, _ in self.pieces if in_main]
        elif "body" in self.seen:
            chosen = [text for text, _, in_body in self.pieces if in_body]
        else:
            chosen = [text for text, _, _ in self.pieces]
        return "\n".join(chosen)


def read_page(html: str) -> tuple[str, list[int], str]:
    """Text, number of each counted tag, and the content root (``main`` or ``body``)."""
    page = PageText()
    page.feed(html)
    text = page.finish()
    return text, [page.counts[name] for name in COUNTED], "main" if page.found_main else "body"
