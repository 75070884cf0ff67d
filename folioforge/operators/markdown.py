"""HTML to Markdown: a small tree with the recoveries that real pages need, and a writer for it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noframes ol output p pre section summary table tbody td tfoot th thead tr ul".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Dropped with all they hold.
DROPPED = frozenset("script style nav footer header noscript head title template".split())
#: A direct child of these kinds makes a link a card.
CARD = frozenset("h1 h2 h3 h4 h5 h6 p div figure picture section img".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.children)
        return "".join(out)


class Tree(HTMLParser):
    """Closes what authors leave open: paragraphs before blocks, items before items, formatting across paragraphs."""

    CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", {}, None)
        self.depth = 0
        self.formatting: list[tuple[str, dict[str, str]]] = []

    def _open(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if self.depth < 256:  # deeper markup stays flat
            self.at, self.depth = node, self.depth + 1
        return node

    def _close_to(self, node: Node) -> None:
        while self.at is not node.parent and self.at.parent is not None:
            self.at, self.depth = self.at.parent, self.depth - 1

    def _find(self, tags: set[str] | frozenset[str], fence: set[str] | frozenset[str] = frozenset()) -> Node | None:
        n = self.at
        while n is not None and n.parent is not None and n.tag not in fence:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def _reopen(self) -> None:
        """Formatting that an implied end closed goes on in what follows."""
        held, n = set(), self.at
        while n is not None:
            held.add(n.tag)
            n = n.parent
        for tag, attrs in self.formatting:
            if tag not in held:
                self._open(tag, attrs)

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            return
        if tag in BLOCK and (p := self._find({"p"}, frozenset({"table", "td", "th", "button"}))):
            self._close_to(p)
        if tag in self.CLOSES and (n := self._find(self.CLOSES[tag], self.FENCE[tag])):
            self._close_to(n)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.at.tag):
            self._close_to(self.at)
        if tag == "a" and (n := self._find({"a"})):
            self._close_to(n)
            self.formatting = [f for f in self.formatting if f[0] != "a"]
        if tag in VOID:
            if tag in ("br", "img"):
                self._reopen()
            self.at.children.append(Node(tag, named, self.at))
            return
        if tag in FORMATTING:
            self._reopen()
            if sum(f[0] == tag for f in self.formatting) < 3:
                self.formatting.append((tag, named))
        self._open(tag, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in FORMATTING:
            for i in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[i][0] == tag:
                    del self.formatting[i]
                    break
        if tag == "br":
            self.handle_starttag("br", [])
        elif n := self._find({tag}, frozenset({"table"}) if tag not in ("table", *BLOCK) else frozenset()):
            self._close_to(n)
        elif tag == "p":
            self._open("p", {})
            self._close_to(self.at)

    def handle_data(self, data):
        if data.strip():
            self._reopen()
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_ESCAPES = (
    (re.compile(r"\\"), r"\\\\"), (re.compile(r"\*"), r"\\*"), (re.compile(r"^-"), r"\\-"), (re.compile(r"^\+ "), r"\\+ "), (re.compile(r"^(=+)"), r"\\\1"), (re.compile(r"^(#{1,6}) "), r"\\\1 "),
    (re.compile(r"`"), r"\\`"), (re.compile(r"^~~~"), r"\\~~~"), (re.compile(r"\["), r"\\["), (re.compile(r"\]"), r"\\]"), (re.compile(r"^>"), r"\\>"), (re.compile(r"_"), r"\\_"), (re.compile(r"^(\d+)\. "), r"\1\\. "),
)


def escape(text: str) -> str:
    for pattern, by in _ESCAPES:
        text = pattern.sub(by, text)
    return text


class Writer:
    """Headings with #, - for bullets, fences for code, _ for emphasis, tables and strike-through of the GitHub flavour."""

    def write(self, root: Node) -> str:
        return self._children(root).strip()

    def _children(self, node: Node) -> str:
        out = ""
        for child in node.children:
            if isinstance(child, str):
                part = escape(re.sub(r"[ \t\r\n]+", " ", child))
                if part.startswith(" ") and (not out or out[-1] in " \n"):
                    part = part[1:]
            else:
                part = self._node(child)
                if child.tag == "br":
                    out = out.rstrip(" ")
            out = self._join(out, part)
        return out

    @staticmethod
    def _join(a: str, b: str) -> str:
        left, right = a.rstrip("\n"), b.lstrip("\n")
        gap = max(len(a) - len(left), len(b) - len(right))
        if not gap:
            return a + b
        if gap and not left.endswith("  "):  # two spaces are a line break's own
            left = left.rstrip(" ")
        return left + "\n" * min(2, gap) + right

    @staticmethod
    def _around(mark: str, inner: str) -> str:
        bare = inner.strip()
        if not bare:
            return inner
        start, end = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{start}{mark}{bare}{mark}{end}"

    def _node(self, n: Node) -> str:
        tag = n.tag
        if tag in DROPPED:
            return ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n* * *\n\n"
        if tag == "img":
            src = n.attrs.get("src", "")
            title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
            return f"![{re.sub(chr(10) + '+', chr(10), n.attrs.get('alt', ''))}]({src}{title})" if src else ""
        if tag == "pre":
            return self._code(n)
        if tag == "a" and n.attrs.get("href") and any(isinstance(c, Node) and c.tag in CARD for c in n.children):
            return self._card(n)
        if tag == "table":
            return self._table(n)
        if tag == "code":
            text = re.sub(r"\r?\n", " ", n.text())
            if not text:
                return ""
            mark = "`"
            while mark in re.findall("`+", text):
                mark += "`"
            pad = " " if re.search(r"^`|^ .*[^ ].* $|`$", text) else ""
            return f"{mark}{pad}{text}{pad}{mark}"
        inner = self._children(n)
        if tag in ("strong", "b"):
            return self._around("**", inner)
        if tag in ("em", "i"):
            return self._around("_", inner)
        if tag in ("del", "s", "strike"):
            return self._around("~~", inner)
        if tag == "a" and n.attrs.get("href"):
            title = n.attrs.get("title")
            return f"[{inner.strip()}]({n.attrs['href']}{' ' + chr(34) + title + chr(34) if title else ''})" if inner.strip() else ""
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {inner.strip()}\n\n" if inner.strip() else ""
        if tag in ("ul", "ol"):
            nested = n.parent is not None and n.parent.tag == "li" and n.parent.children and n.parent.children[-1] is n
            return f"\n{inner.strip(chr(10))}" if nested else f"\n\n{inner.strip(chr(10))}\n\n"
        if tag == "li":
            return self._item(n, inner)
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}" for line in inner.strip().split("\n")) + "\n\n" if inner.strip() else ""
        if tag in BLOCK:
            return f"\n\n{inner.strip(chr(10))}\n\n" if inner.strip() else ""
        return inner

    @staticmethod
    def _item(n: Node, inner: str) -> str:
        mark = "-   "
        if n.parent is not None and n.parent.tag == "ol":
            items = [c for c in n.parent.children if isinstance(c, Node) and c.tag == "li"]
            start = int(n.parent.attrs["start"]) if n.parent.attrs.get("start", "").isdigit() else 1
            mark = f"{start + items.index(n)}.  "
        body = re.sub(r"\n+\Z", "\n", inner.lstrip("\n")).rstrip("\n").replace("\n", "\n    ")
        return f"{mark}{body}\n"

    @staticmethod
    def _code(n: Node) -> str:
        text = n.text().removesuffix("\n")
        inner = next((c for c in n.children if isinstance(c, Node)), None)
        language = re.search(r"language-(\S+)", (inner or n).attrs.get("class", ""))
        fence = "```"
        while re.search(rf"(?m)^{fence}", text):
            fence += "`"
        return f"\n\n{fence}{language[1] if language else ''}\n{text}\n{fence}\n\n"

    @staticmethod
    def _card(n: Node) -> str:
        """Pictures first, as blocks of their own; then one link with the texts."""
        pictures, texts = [], []
        for c in n.children:
            if isinstance(c, Node) and c.tag == "img":
                if c.attrs.get("src"):
                    pictures.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
            elif text := re.sub(r"\s+", " ", c if isinstance(c, str) else c.text()).strip():
                texts.append(text)
        link = f"[{' -- '.join(texts) or n.attrs['href']}]({n.attrs['href']})"
        return "\n\n" + "\n\n".join([*pictures, link]) + "\n\n"

    def _cell(self, n: Node) -> str:
        lines = (re.sub(r"^\s*(?:[-*+]|•)\s+", "", line).strip() for line in self._children(n).split("\n"))
        return "<br>".join(line for line in lines if line)

    def _table(self, n: Node) -> str:
        rows: list[list[Node]] = []

        def walk(x: Node) -> None:
            for c in x.children:
                if isinstance(c, Node) and c.tag == "tr":
                    if cells := [d for d in c.children if isinstance(d, Node) and d.tag in ("td", "th")]:
                        rows.append(cells)
                elif isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot"):
                    walk(c)

        walk(n)
        if not rows:
            inner = self._children(n).strip()
            return f"\n\n{inner}\n\n" if inner else ""
        lines = ["| " + " | ".join(self._cell(c) for c in row) + " |" for row in rows]
        width = max(map(len, rows))
        if not all(c.tag == "th" for c in rows[0]):
            lines.insert(0, "|" + "  |" * width)
        marks = {"left": ":--", "right": "--:", "center": ":-:"}
        head = rows[0] if all(c.tag == "th" for c in rows[0]) else []
        lines.insert(1, "| " + " | ".join([marks.get(c.attrs.get("align", "").lower(), "---") for c in head] or ["---"] * width) + " |")
        return "\n\n" + "\n".join(lines) + "\n\n"


def convert(html: str) -> str:
    return Writer().write(parse(html))
