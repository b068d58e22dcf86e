"""Portal pages: text, key-value pairs, tables, contacts and dates from HTML.

Pages are parsed in batches; a page that can't be parsed gives its error, never an exception.
Defined results: null and empty pages give empty text; scripts, styles, navigation and noscript parts are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = {"script", "style", "nav", "noscript"}
VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "source", "wbr"}
_PHONE = re.compile(r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
#: Labels of the two dates, by priority.
PUBLISHED = ["Publication", "Publication Date", "Published", "Posted Date", "Issue Date"]
CLOSING = ["Closing Date", "Due Date", "Bid Due Date", "Close Date"]
SCHEMA = "text string, sections string, pairs map<string,string>, tables array<string>, contact string, published_date string, closing_date string, error string"


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self, by: str = " ") -> str:
        parts: list[str] = []
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                todo.extend(reversed(c.children))
            elif c.strip():
                parts.append(c.strip())
        return by.join(parts)

    def next(self) -> Node | None:
        """The next element beside this one."""
        beside = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        k = beside.index(self) + 1 if self in beside else len(beside)
        return beside[k] if k < len(beside) else None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.off = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.off += 1
        elif not self.off:
            if tag in ("dt", "dd", "li", "tr", "td", "th") and self.at.tag == tag:
                self.at = self.at.parent
            node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
            self.at.children.append(node)
            if tag not in VOID:
                self.at = node

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.off = max(0, self.off - 1)
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.at.children.append(data)


def parse_tree(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def table_markdown(node: Node) -> str | None:
    """Markdown of a table with two rows and two filled columns at least; else None."""
    rows = [[c.text() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2:
        return None
    rows = [r + [""] * (width - len(r)) for r in rows]
    if sum(any(r[k] for r in rows) for k in range(width)) < 2:
        return None
    head = rows[0]
    if not any(head):
        if width != 2:
            return None
        head = ["Field", "Value"]
    safe = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([safe(head), "|" + " --- |" * width, *map(safe, rows[1:])])


def key_values(root: Node) -> dict[str, str]:
    """Pairs of description lists (later wins) and of elements whose class names a label (first wins); phone numbers are no keys."""
    out: dict[str, str] = {}

    def put(key: str, value: str, over: bool) -> None:
        key = key.strip().rstrip(": ")
        if key and value and len(key) < 80 and not _PHONE.fullmatch(key) and (over or key not in out):
            out[key] = value

    for n in root.walk():
        if n.tag == "dt" and (d := n.next()) is not None and d.tag == "dd":
            put(n.text(), d.text(), True)
    for n in root.walk():
        if "label" in n.attrs.get("class", "").lower() and (d := n.next()) is not None:
            put(n.text(), d.text(), False)
    return out


def contact(root: Node, pairs: dict[str, str]) -> str:
    text = root.text("\n")
    name = next((v for k, v in pairs.items() if re.search(r"(?i)contact|buyer|procurement officer|agent", k) and "@" not in v), None)
    mail, phone = _MAIL.search(text), _PHONE.search(text)
    return " | ".join(x for x in (name, mail and mail[0], phone and phone[0]) if x)


def collapse_repeats(text: str, longest: int = 7) -> str:
    """Spans of up to ``longest`` words that stand twice in a row stand once; trailing repeats of the first two words go."""
    w = text.split()
    for n in range(longest, 0, -1):
        i = 0
        while i + 2 * n <= len(w):
            if [x.lower() for x in w[i : i + n]] == [x.lower() for x in w[i + n : i + 2 * n]]:
                del w[i + n : i + 2 * n]
            else:
                i += 1
    if len(w) > 3 and w[-2:] == w[:2]:
        del w[-2:]
    return " ".join(w)


def scope_items(text: str) -> list[str]:
    """Numbered scope items as ``n. title note | Quantity: q | Due Date: d``; a text without numbers stays one item."""
    text = re.sub(r"(?i)\b(?:see more|see less|read more)\b", "", text)
    parts = [p.strip() for p in re.split(r"(?=\b\d+\.\s+)", text) if p.strip()]
    out = []
    for p in parts:
        m = re.match(r"(\d+)\.\s+(.*)", p, re.S)
        if not m:
            out.append(collapse_repeats(p))
            continue
        body, tail = m[2], ""
        if d := re.search(r"\s(?:(\d+)\s+)?(\d{1,2}/\d{1,2}/\d{2,4})\s*$", body):
            body = body[: d.start()]
            tail = (f" | Quantity: {d[1]}" if d[1] else "") + f" | Due Date: {d[2]}"
        note = re.search(r"\*[^*]+\*", body)
        if note:
            body = body.replace(note[0], " ")
        out.append(f"{m[1]}. {collapse_repeats(body)}" + (f" {note[0]}" if note else "") + tail)
    return out


#: The sections of an assembled page, and the keys whose value is its scope.
DETAILS, SCOPE, ITEMS = "### Portal Bid Details & Schedule", "### Scope & Description", "### Portal Specifications & Line Items"
SCOPE_KEYS = ["Description", "Scope of Work"]


def sections(root: Node, pairs: dict[str, str], tables: list[str]) -> str:
    """A page in labeled sections: its pairs as a list, its scope (else the text of an element whose class names a description), its tables."""
    low = {k.lower(): v for k, v in pairs.items()}
    scope = next((low[k.lower()] for k in SCOPE_KEYS if low.get(k.lower())), None)
    if not scope:
        scope = next((n.text() for n in root.walk() if "description" in n.attrs.get("class", "").lower() and n.text()), None)
    out = ["\n".join([DETAILS, *(f"- **{k}**: {v}" for k, v in pairs.items() if k not in SCOPE_KEYS)])]
    if scope:
        out.append(SCOPE + "\n" + "\n".join(scope_items(scope)))
    if tables:
        out.append("\n\n".join([ITEMS, *tables]))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def parse(html: str | None) -> dict:
    empty = {"text": "", "sections": "", "pairs": {}, "tables": [], "contact": "", "published_date": None, "closing_date": None, "error": None}
    if not html:
        return empty
    try:
        root = parse_tree(html)
        pairs = key_values(root)
        low = {k.lower(): v for k, v in pairs.items()}
        pick = lambda names: next((low[n.lower()] for n in names if low.get(n.lower())), None)
        who = contact(root, pairs)
        kept = {k: v for k, v in pairs.items() if k.lower() not in {n.lower() for n in PUBLISHED + CLOSING} and (not who or (k not in who and v not in who))}
        tables = [t for n in root.walk() if n.tag == "table" and (t := table_markdown(n))]
        return empty | {"text": root.text("\n"), "sections": sections(root, ({"Contact Info": who} if who else {}) | kept, tables), "pairs": kept, "tables": tables, "contact": who, "published_date": pick(PUBLISHED), "closing_date": pick(CLOSING)}
    except Exception as e:  # noqa: BLE001
        return empty | {"error": f"{type(e).__name__}: {e}"}


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows with the parts of their page added. ``html`` may be text or bytes."""
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [h.decode("utf-8", "ignore") if isinstance(h, (bytes, bytearray)) else h for h in pdf[html]]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame([parse(h) for h in raw])], axis=1)

    return pages.mapInPandas(run, StructType([*pages.schema.fields, *StructType.fromDDL(SCHEMA).fields]))
