"""Small per-page helper: HTML text to flat arrays of elements and text pieces.

It runs inside ``mapInArrow`` tasks and holds the two steps that are
sequential by nature: matching start with end tags, and laying out cells that
span rows or columns.  What the arrays mean is decided in Spark expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Elements without an end tag, elements whose text is not page text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template", "rt", "rp"}

# Tags without attributes, of which most pages are made; what follows script and style is not markup.
_PLAIN_START = re.compile(r"<(?!(?i:script|style)>)([A-Za-z][A-Za-z0-9]*)>")
_PLAIN_END = re.compile(r"</([A-Za-z][A-Za-z0-9]*)>")
# Such a tag with the text before it, where no reference has to be resolved; pages are read so as far as they go.
_PLAIN = re.compile(r"([^<&]*)<(/?)(?!(?:script|style)>)([A-Za-z][A-Za-z0-9]*)>", re.IGNORECASE | re.ASCII)
# A script or style without attributes up to its end tag, where nothing in it begins an end tag or a comment.
_PLAIN_CODE = re.compile(r"([^<&]*)<(script|style)>([^<]*(?:<(?![/!])[^<]*)*)</\2>", re.IGNORECASE | re.ASCII)
_RUNS = re.compile(r"[\r\n]+|\s{2,}")


class PageParser(HTMLParser):
    """Collects ``nodes`` in document order and ``texts`` between tags.

    An element's subtree is ``nodes[pos + 1 : end]`` and its text is
    ``texts[t0:t1]``.  End tags close up to the nearest open element of that
    name, stray ones are ignored, and no end tag is ever implied.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self._open: list[dict] = []
        self._count: Counter[str] = Counter()
        self._hidden = 0
        self._pending: list[str] = []
        rest = self._read_plain(html)
        if rest < len(html):
            self.feed(html[rest:])
            self.close()
        self._flush()
        while self._open:
            self._close_top()

    def _read_plain(self, html: str) -> int:
        """Read tags without attributes, the text before them and plain scripts; the place of the first other markup."""
        place, match, code = 0, _PLAIN.match, _PLAIN_CODE.match
        while found := match(html, place) or code(html, place):
            if found[1]:
                self._pending.append(found[1])
            if found.re is _PLAIN_CODE:
                tag = found[2].lower()
                self.handle_starttag(tag, ())
                if found[3]:
                    self._pending.append(found[3])
                self.handle_endtag(tag)
                place = found.end()
                continue
            ending, tag = found[2], found[3]
            if ending:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), ())
            place = found.end()
        return place

    def _flush(self) -> None:
        if not self._pending:
            return
        text, self._pending = "".join(self._pending), []
        if text and self._hidden:
            node = self._nearest(*HIDDEN)
            node["raw"] = (node["raw"] or "") + text
        elif text.strip():
            self.texts.append(text)
        elif text:
            self.texts.append(" ")

    def _close_top(self) -> None:
        node = self._open.pop()
        self._count[node["tag"]] -= 1
        self._hidden -= node["tag"] in HIDDEN
        node["end"], node["t1"] = len(self.nodes), len(self.texts)

    def _nearest(self, *tags: str) -> dict | None:
        return next((node for node in reversed(self._open) if node["tag"] in tags), None)

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if not plain:
            return super().parse_starttag(i)
        self.lasttag = plain[1].lower()
        self.handle_starttag(self.lasttag, [])
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else _PLAIN_END.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        self._flush()
        owner = None
        if tag == "tr":
            owner = self._nearest("table")
        elif tag in ("td", "th"):
            owner = self._nearest("tr", "table")
        node = {
            "tag": tag,
            "attrs": {name: value or "" for name, value in attrs} if attrs else {},
            "pos": len(self.nodes),
            "t0": len(self.texts),
            "raw": None,
            "owner": owner["pos"] if owner else None,
        }
        self.nodes.append(node)
        self._open.append(node)
        self._count[tag] += 1
        self._hidden += tag in HIDDEN
        if tag in VOID:
            self._close_top()

    def pruned(self, tags: set[str], attributes: set[str] | None) -> tuple[list[dict], list[str]]:
        """Nodes of the wanted tags with the wanted attributes, and the texts below them; places count what is left."""
        kept, before = [], [0]
        for node in self.nodes:
            if node["tag"] in tags:
                kept.append(node)
            before.append(len(kept))
        nodes, texts, covered, shift = [], [], 0, 0
        for node in kept:
            if node["t0"] >= covered:
                shift, covered = len(texts) - node["t0"], node["t1"]
                texts += self.texts[node["t0"] : node["t1"]]
            attrs = node["attrs"]
            if attributes is not None and attrs:
                attrs = {name: value for name, value in attrs.items() if name in attributes}
            nodes.append(
                node
                | {"attrs": attrs, "pos": before[node["pos"]], "end": before[node["end"]], "t0": node["t0"] + shift, "t1": node["t1"] + shift}
            )
        return nodes, texts

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_top()

    def handle_endtag(self, tag):
        self._flush()
        if tag not in VOID and self._count[tag]:
            while self._open[-1]["tag"] != tag:
                self._close_top()
            self._close_top()

    def handle_data(self, data):
        self._pending.append(data)

    def _break(self, _):
        self._flush()

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    handle_comment = handle_decl = handle_pi = unknown_decl = _break

    def tables(self) -> list[list[list[str | None]]]:
        """Cell texts of every table, spans laid out; the first row is the header."""
        rows: dict[int, list[dict]] = {}
        cells: dict[int, list[dict]] = {}
        for node in self.nodes:
            if node["owner"] is not None and not _is_hidden(node):
                group = rows if node["tag"] == "tr" else cells
                group.setdefault(node["owner"], []).append(node)
        out = []
        for table in (node for node in self.nodes if node["tag"] == "table"):
            own = [cells.get(row["pos"], []) for row in rows.get(table["pos"], [])]
            starts = [cell["t0"] for row in own for cell in row] + [table["t1"]]
            lines, seen = [], 0
            for row in own:
                line = []
                for cell in row:
                    seen += 1
                    text = "".join(self.texts[cell["t0"] : min(cell["t1"], starts[seen])])
                    tidy = _RUNS.sub(" ", text.strip())
                    line.append((tidy, _span(cell, "colspan"), _span(cell, "rowspan")) if cell["attrs"] else (tidy, 1, 1))
                if line:
                    lines.append(line)
            out.append(lay_out(lines))
        return out


def _is_hidden(node: dict) -> bool:
    return bool(node["attrs"]) and "display:none" in node["attrs"].get("style", "").replace(" ", "")


# The HTML standard's largest spans.
MOST_SPAN = {"colspan": 1000, "rowspan": 65534}


def _span(cell: dict, name: str) -> int:
    value = cell["attrs"].get(name, "1").strip()[:9]
    return min(max(1, int(value)), MOST_SPAN[name]) if value.isdecimal() else 1


def lay_out(lines: list[list[tuple[str, int, int]]]) -> list[list[str | None]]:
    """Repeat spanning cells over the grid positions they cover, down to the table's last row."""
    grid: list[list[str | None]] = []
    carried: dict[int, tuple[str, int]] = {}
    for cells in lines:
        if not carried and all(across == down == 1 for _, across, down in cells):
            grid.append([text for text, _, _ in cells])
            continue
        line = {col: text for col, (text, _) in carried.items()}
        carried = {col: (text, left - 1) for col, (text, left) in carried.items() if left > 1}
        col = 0
        for text, across, down in cells:
            for _ in range(across):
                while col in line:
                    col += 1
                line[col] = text
                if down > 1:
                    carried[col] = (text, down - 1)
        grid.append([line.get(i) for i in range(max(line, default=-1) + 1)])
    return grid
