"""Per-document helper: read HTML into a small tree, render it, pick its main region.

Only this work leaves the JVM.  It runs inside ``mapInPandas`` tasks of
:mod:`lucidex.operators.conversion`; text preparation, signals and scores are native.
"""

from __future__ import annotations

import re
from html import escape, unescape

#: Element classes.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style".split())
BLOCK = frozenset(
    "h1 h2 h3 h4 h5 h6 p div section article main header footer aside ul ol li blockquote pre hr "
    "table thead tbody tr figure figcaption".split())
LISTS = frozenset("ul ol".split())
DROPPED = frozenset("script style noscript template".split())

#: Which open element a new start tag closes, as HTML 4 parsers repair it.
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_CELLS = "td th"
CLOSED_BY = {name: frozenset(tags.split()) for name, tags in {
    "p": f"address blockquote body caption center col colgroup dd dir div dl dt fieldset form {_HEADINGS} "
         f"head hr li menu ol p pre table tbody {_CELLS} tfoot thead title tr ul",
    **{h: f"{_HEADINGS} fieldset form li p table" for h in _HEADINGS.split()},
    **{inline: f"center p {_CELLS}" for inline in "b font i s small strike tt u big".split()},
    "a": f"a fieldset table {_CELLS}",
    "li": "li", "dt": "dd dl", "dd": "dt", "option": "option optgroup",
    "td": f"tbody tfoot thead {_CELLS} tr", "th": f"tbody tfoot thead {_CELLS} tr",
    "tr": "tbody tfoot thead tr", "thead": "tbody tfoot", "tbody": "tbody tfoot", "tfoot": "tbody",
    "caption": "col colgroup tbody tfoot thead tr", "title": "body", "style": "body", "script": "noscript",
}.items()}

#: How strongly an element resists the end tag of an outer one.
END_STRENGTH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
                "table": 190, "head": 200, "body": 200, "html": 220}

#: Region rules.
CHROME_TAGS = frozenset("nav header footer aside form script style noscript template".split())
CHROME_ROLES = frozenset("navigation banner contentinfo search complementary".split())
CONTENT_HINTS = ("entry-content", "site-content", "content-area", "post-content", "page-content")
REGION_MIN_BYTES = 200

#: Limits of the renderer.
MAX_DEPTH = 64
DEEP_DIV = 4

COUNTERS = ("tags", "empty_tags", "styled_tags", "divs", "deep_divs", "paragraphs",
            "image_paragraphs", "tables", "broken_tables")

_TRIM = " \n\r\t\x0b\x00"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_BLOB = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}")
_BLANKS = re.compile(r"\s+")
_LANGUAGE = re.compile(r"language-([\w-]+)", re.A)


class Node:
    """An element (``tag`` set) or a text (``tag`` None, ``text`` set)."""

    __slots__ = ("tag", "raw_attrs", "kids", "text", "_attrs")

    def __init__(self, tag: str | None, raw_attrs: str = "", text: str = ""):
        self.tag, self.raw_attrs, self.text = tag, raw_attrs, text
        self.kids: list[Node] = []
        self._attrs: dict[str, str] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            found: dict[str, str] = {}
            for name, double, single, bare in _ATTR.findall(self.raw_attrs):
                found.setdefault(name.lower(), unescape(double or single or bare))
            self._attrs = found
        return self._attrs

    def full_text(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.tag is None:
                parts.append(node.text)
            todo.extend(reversed(node.kids))
        return "".join(parts)

    def walk(self):
        """Elements below this one in document order."""
        todo = list(reversed(self.kids))
        while todo:
            node = todo.pop()
            if node.tag is not None:
                yield node
                todo.extend(reversed(node.kids))


def read_tree(source: str) -> Node:
    """Tree of a fragment or page, with the repairs of an HTML 4 parser."""
    root = Node("wrapper")
    stack = [root]
    at, size, has_body = 0, len(source), False

    def add_text(text: str, decode: bool = True) -> None:
        if text:
            stack[-1].kids.append(Node(None, text=unescape(text) if decode else text))

    while at < size:
        match = _TOKEN.search(source, at)
        if match is None:
            add_text(source[at:])
            break
        add_text(source[at:match.start()])
        at = match.end()
        closing, name, attrs = match.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            _close(stack, name)
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        if name in ("html", "head") or (name == "body" and has_body):
            continue
        has_body = has_body or name == "body"
        node = Node(name, attrs or "")
        stack[-1].kids.append(node)
        if name in RAW_TEXT:
            end = re.compile(f"</{name}[^>]*>", re.I).search(source, at)
            inside, at = (source[at:end.start()], end.end()) if end else (source[at:], size)
            if inside:
                node.kids.append(Node(None, text=inside))
        elif name not in VOID and not _SELF_CLOSED.search(attrs or ""):
            stack.append(node)
    return root


def _close(stack: list[Node], name: str) -> None:
    """Apply an end tag: weaker open elements close with it, stronger ones stop it."""
    if name == "p" and all(node.tag != "p" for node in stack[1:]):
        stack[-1].kids.append(Node("p"))
        return
    strength = END_STRENGTH.get(name, 100)
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == name:
            del stack[depth:]
            return
        if END_STRENGTH.get(stack[depth].tag, 100) > strength:
            return


class Renderer:
    """Markdown of a tree.  ``counts`` holds the quality counters afterwards."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTERS, 0)

    def inside(self, node: Node, depth: int) -> str:
        """The children of *node*, one level deeper than *depth*."""
        if depth > MAX_DEPTH:
            return ""
        return "".join([self.child(node, i, depth) for i in range(len(node.kids))])

    def child(self, node: Node, i: int, depth: int) -> str:
        kids = node.kids
        kid = kids[i]
        if kid.tag is not None:
            return self.element(kid, depth + 1)
        at_edges = ((i == 0 or kids[i - 1].tag in BLOCK)
                    and (i == len(kids) - 1 or kids[i + 1].tag in BLOCK))
        return self.plain(kid.text, at_edges)

    @staticmethod
    def plain(text: str, at_block_edges: bool) -> str:
        if len(text) >= 60:
            text = _BLOB.sub("", text)
        if not text.strip(_TRIM):
            return "" if at_block_edges else " "
        return _BLANKS.sub(" ", text)

    def element(self, node: Node, depth: int) -> str:
        tag, counts = node.tag, self.counts
        counts["tags"] += 1
        if node.raw_attrs and ("style" in node.attrs or "class" in node.attrs):
            counts["styled_tags"] += 1
        if tag == "div":
            counts["divs"] += 1
            counts["deep_divs"] += depth > DEEP_DIV
        out = self.markup(node, tag, depth)
        if not out:
            counts["empty_tags"] += 1
        return out

    def markup(self, node: Node, tag: str, depth: int) -> str:
        if tag in DROPPED:
            return ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return image(node)
        if tag == "code":
            return code_span(node.full_text())
        if tag == "pre":
            return code_block(node)
        if tag == "table":
            return self.table(node)
        if tag in LISTS:
            return "\n\n" + self.items(node, depth, 0).rstrip("\n") + "\n\n"
        if tag == "figure":
            return self.figure(node, depth)
        if tag == "p":
            self.counts["paragraphs"] += 1
            self.counts["image_paragraphs"] += holds_one_image(node)
        inner = self.inside(node, depth)
        if tag in ("em", "i"):
            return f"*{inner}*"
        if tag in ("strong", "b"):
            return f"**{inner}**"
        if tag == "a":
            return link(node, inner)
        if tag == "p":
            return as_block(inner.strip(_TRIM))
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            title = inner.strip(_TRIM)
            return as_block("#" * int(tag[1]) + " " + title) if title else ""
        if tag == "blockquote":
            quoted = re.sub(r"\n{3,}", "\n\n", inner.strip(_TRIM))
            return as_block("\n".join("> " + line if line else ">" for line in quoted.split("\n"))) if quoted else ""
        return inner

    def items(self, node: Node, depth: int, level: int) -> str:
        lines = []
        for kid in node.kids:
            if kid.tag != "li":
                continue
            marker = f"{len(lines) + 1}." if node.tag == "ol" else "-"
            lines.append("  " * level + marker + " " + self.item(kid, depth, level) + "\n")
        return "".join(lines)

    def item(self, node: Node, depth: int, level: int) -> str:
        own, nested = [], []
        for i, kid in enumerate(node.kids):
            if kid.tag in LISTS:
                nested.append("\n" + self.items(kid, depth, level + 1))
            else:
                own.append(self.child(node, i, depth))
        line = _BLANKS.sub(" ", "".join(own)).strip(_TRIM)
        return line + "".join(nested).rstrip("\n")

    def figure(self, node: Node, depth: int) -> str:
        if "wp-block-embed" in node.attrs.get("class", ""):
            for tag, source in (("iframe", "src"), ("a", "href")):
                for found in node.walk():
                    target = found.attrs.get(source, "") if found.tag == tag else ""
                    if target:
                        return as_block(f"[{target}]({target})")
            return self.inside(node, depth)
        picture = caption = ""
        for kid in node.kids:
            if kid.tag == "img":
                picture = image(kid)
            elif kid.tag == "a":
                picture = link(kid, self.inside(kid, depth))
            elif kid.tag == "figcaption":
                caption = self.inside(kid, depth).strip(_TRIM)
        if not picture:
            return self.inside(node, depth)
        return as_block(picture + (f"\n*{caption}*" if caption else ""))

    def table(self, node: Node) -> str:
        self.counts["tables"] += 1
        rows, headed = [], False
        for row in node.walk():
            if row.tag != "tr":
                continue
            cells = [kid for kid in row.kids if kid.tag in ("td", "th")]
            headed = headed or any(cell.tag == "th" for cell in cells)
            if cells:
                rows.append([_BLANKS.sub(" ", cell.full_text()).strip(_TRIM) for cell in cells])
        if not rows or not headed or len({len(row) for row in rows}) > 1:
            self.counts["broken_tables"] += 1
        if not rows:
            return ""
        width = len(rows[0])
        grid = [rows[0], ["---"] * width] + [row + [""] * (width - len(row)) for row in rows[1:]]
        return as_block("\n".join("| " + " | ".join(row) + " |" for row in grid))


def as_block(text: str) -> str:
    return f"\n\n{text}\n\n" if text else ""


def holds_one_image(node: Node) -> bool:
    kids = [kid for kid in node.kids if kid.tag is not None or kid.text.strip(_TRIM)]
    return len(kids) == 1 and kids[0].tag == "img"


def code_span(text: str) -> str:
    if not text:
        return "``"
    fence = "`" * (max(map(len, re.findall("`+", text)), default=0) + 1)
    pad = " " if "`" in (text[0], text[-1]) else ""
    return fence + pad + text + pad + fence


def code_block(node: Node) -> str:
    inner = next((kid for kid in node.kids if kid.tag == "code"), None)
    language = _LANGUAGE.search(inner.attrs.get("class", "")) if inner else None
    text = (inner.full_text() if inner else "") or node.full_text()
    return as_block("```" + (language.group(1) if language else "") + "\n" + text.rstrip("\n") + "\n```")


def _escape(text: str, marks: str) -> str:
    return re.sub("([\\\\" + marks + "])", r"\\\1", text)


def link(node: Node, inner: str) -> str:
    href = node.attrs.get("href", "")
    if not href:
        return inner
    shown = inner if inner.strip(_TRIM) else href
    return f"[{_escape(shown, '[' + chr(92) + ']')}]({_escape(href, ')')})"


def image(node: Node) -> str:
    src = node.attrs.get("src", "")
    if not src:
        return ""
    return f"![{_escape(node.attrs.get('alt', ''), '[' + chr(92) + ']')}]({_escape(src, ')')})"


def to_markdown(source: str) -> tuple[str, dict[str, int]]:
    """Unfinished Markdown of prepared HTML and its quality counters."""
    renderer = Renderer()
    return renderer.inside(read_tree(source), 0), renderer.counts


# --- main region -----------------------------------------------------------------


def main_region(source: str) -> str:
    """Inner HTML of the part of a page that carries its content."""
    if not source.strip(_TRIM):
        return ""
    root = read_tree(source)
    _drop_chrome(root)
    region = _pick(root)
    return "".join(map(to_html, region.kids))


def _drop_chrome(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [kid for kid in node.kids if kid.tag is None or not (
            kid.tag in CHROME_TAGS or kid.attrs.get("role") in CHROME_ROLES)]
        todo.extend(kid for kid in node.kids if kid.tag is not None)


def _pick(root: Node) -> Node:
    elements = list(root.walk())
    wanted = [lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main"]
    wanted += [lambda n, hint=hint: hint in n.attrs.get("class", "").split() or n.attrs.get("id") == hint
               for hint in CONTENT_HINTS]
    for test in wanted:
        found = next(filter(test, elements), None)
        if found is not None:
            return found
    best, most = root, 0
    for node in elements:
        if node.tag not in ("div", "section"):
            continue
        size = _bytes(node)
        if size < REGION_MIN_BYTES:
            continue
        prose = size - sum(_bytes(a) for a in node.walk() if a.tag == "a")
        if prose > most:
            best, most = node, prose
    return best


def _bytes(node: Node) -> int:
    return len(node.full_text().strip(_TRIM).encode())


def to_html(node: Node) -> str:
    """HTML text of a subtree, written without recursion."""
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag is None:
            out.append(escape(item.text, quote=False))
        else:
            attrs = "".join(f' {name}="{escape(value)}"' for name, value in item.attrs.items())
            out.append(f"<{item.tag}{attrs}>")
            if item.tag not in VOID:
                todo.append(f"</{item.tag}>")
                todo.extend(reversed(item.kids))
    return "".join(out)
