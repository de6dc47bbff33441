"""The row-level helper of `parse_dom`: page sources to flat Arrow columns.

Recovery rules for malformed markup: void elements take no children; a start tag listed in `_ENDS`
first closes the open elements named there; an end tag closes the nearest open element of its name
that is not outside the current table cell; other stray end tags are ignored. A quote without a partner
is an ordinary character, and a tag whose quotes leave it no end stops at the next `>`. An unclosed
comment, script or style reaches to the end; a `<` that begins nothing is text. The contents of `script`
and `style` stay out of the text of their ancestors. Nesting has no limit, and time is linear in the page.
"""

import re
import sys
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle

# executors get this module with the task, so they need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdo big button cite code dfn em font i img input kbd label map mark object q s samp "
    "script select small span strong style sub sup textarea time tt u var wbr".split()
)
_BLOCK_START = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SECTIONS = frozenset(["thead", "tbody", "tfoot"])
_CELLS = frozenset(["td", "th"])
# start tag -> (open elements it ends, elements the search does not leave)
_ENDS = {
    **{t: (frozenset(["p"]), frozenset("td th table button caption".split())) for t in _BLOCK_START},
    "li": (frozenset(["li"]), frozenset("ul ol menu td th table".split())),
    **{t: (frozenset(["dt", "dd"]), frozenset(["dl", "table"])) for t in ("dt", "dd")},
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **{t: (_CELLS, frozenset(["tr", "table"])) for t in _CELLS},
    "tr": (_CELLS | {"tr"}, frozenset(["table"])),
    **{t: (_CELLS | _SECTIONS | {"tr"}, frozenset(["table"])) for t in _SECTIONS},
    "body": (frozenset(["head"]), frozenset()),
}
_TABLE_PART = _CELLS | _SECTIONS | {"tr", "table"}

# elements whose text a reader does not see
_UNSEEN = frozenset("head title style script meta".split())

# text | a tag without < or > in its values
_PLAIN = re.compile(
    r"([^<]+)|<(/?)([A-Za-z][^\s/<>\"']*)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>", re.S
)
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_RAW = re.compile(r"(?i:script|style)(?=[\s/>])")
_RAW_END = {t: re.compile(rf"</(?i:{t})") for t in ("script", "style")}
_TO_QUOTE = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]{2,}|[\t\n\f\r]")

# text parsed before a batch of results is handed on
_SLICE_CHARS = 4 << 20

NODE_FIELDS = ["idx", "parent", "depth", "prev", "nth", "sub_end", "tag", "id", "classes", "attrs", "c0", "c1", "unseen"]


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, html: str):
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.failed: list[tuple[list[int], list[int]]] = []

    def end(self, start: int) -> int:
        """Place of the > that ends the tag whose attributes begin at `start`: the first outside quotes, or else the
        first at all. A way through the quotes that found none is kept: a later tag that stands outside its quotes
        would go the same way. There are three ways at most (outside, in either quote), so all searches are linear."""
        html = self.html
        for opened, closed in self.failed:
            i = bisect_right(opened, start) - 1
            if i < 0 or closed[i] < start:
                return html.find(">", start)
        opened, closed, at = [], [], start
        while True:
            at = _TO_QUOTE.match(html, at).end()
            if at == len(html):
                self.failed.append((opened, closed))
                return html.find(">", start)
            c = html[at]
            if c == ">":
                return at
            if at < self.last[c]:
                opened.append(at)
                at = html.index(c, at + 1)
                closed.append(at)
            at += 1


def _tokens(html: str):
    """(kind, tag, attributes or text): kinds are text, start, end and raw (start, then the content apart)."""
    at, n, last = 0, len(html), html.rfind(">")
    tags = None
    while at < n:
        m = _PLAIN.match(html, at)
        if m:
            text, end, tag, attrs = m.groups()
            if text is not None:
                yield "text", text, ""
                at = m.end()
                continue
            tag = tag.lower()
            if end or tag not in _RAW_END:
                yield ("end" if end else "start"), tag, attrs
                at = m.end()
                continue
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            at = n if stop < 0 else stop + 3
            continue
        if at < last and html[at + 1] in "!?":
            at = html.index(">", at) + 1
            continue
        m = _NAME.match(html, at + 1) if at < last else None
        if not m:
            yield "text", "<", ""
            at += 1
            continue
        tag = m[2].lower()
        if not m[1] and _RAW.match(html, at + 1):
            stop = html.index(">", m.end())
            close = _RAW_END[tag].search(html, stop + 1)
            after = html.find(">", close.start()) if close else -1
            yield "raw", tag, (html[m.end() : stop], html[stop + 1 : close.start() if after >= 0 else n])
            at = after + 1 if after >= 0 else n
            continue
        tags = tags or _Tags(html)
        stop = tags.end(m.end())
        yield ("end" if m[1] else "start"), tag, html[m.end() : stop]
        at = stop + 1


class Nodes:
    """Flat column buffers for the elements of many pages."""

    def __init__(self):
        self.page_start = [0]
        self.chunk_start = [0]
        self.chunks = []
        self.scalar = {k: [] for k in ("idx", "parent", "depth", "prev", "nth", "sub_end", "tag", "id", "c0", "c1", "unseen")}
        self.classes, self.class_start = [], [0]
        self.attr_key, self.attr_value, self.attr_start = [], [], [0]

    def add_page(self, html: str) -> None:
        s = self.scalar
        add_parent, add_prev, add_nth, add_depth = s["parent"].append, s["prev"].append, s["nth"].append, s["depth"].append
        add_tag, add_id, add_c0 = s["tag"].append, s["id"].append, s["c0"].append
        sub_end, c1 = s["sub_end"], s["c1"]
        text, raws = [], []
        base, i, unseen = len(sub_end), -1, 0
        # open elements: [index, tag, last child, number of children], and the places of each tag among them
        stack = [[-1, "", -1, 0]]
        places: dict[str, list[int]] = {}

        def close_to(depth: int) -> None:
            nonlocal unseen
            while len(stack) > depth:
                at, tag, *_ = stack.pop()
                places[tag].pop()
                unseen -= tag in _UNSEEN
                sub_end[base + at] = i
                c1[base + at] = len(text)
                if tag not in _INLINE and text and text[-1] != "\n":
                    text.append("\n")

        def nearest(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        for kind, tag, attrs in _tokens(html):
            if kind == "text":
                piece = unescape(tag) if "&" in tag else tag
                piece = _SPACE.sub(" ", piece)
                if piece != " " or (text and text[-1][-1] not in " \n"):
                    text.append(piece)
                continue
            if kind == "end":
                place = nearest((tag,))
                if place and (tag in _TABLE_PART or place >= nearest(_CELLS)):
                    close_to(place)
                continue
            raw = None
            if kind == "raw":
                attrs, raw = attrs
            if tag in _ENDS:
                ended, barrier = _ENDS[tag]
                wall, keep = nearest(barrier), len(stack)
                for t in ended:
                    own = places.get(t)
                    if own and own[-1] > wall:
                        keep = min(keep, own[bisect_right(own, wall)])
                close_to(keep)
            if (tag == "br" or tag not in _INLINE) and text and text[-1] != "\n":
                text.append("\n")
            i += 1
            top = stack[-1]
            add_parent(top[0])
            add_prev(top[2])
            add_depth(len(stack) - 1)
            top[2] = i
            top[3] += 1
            add_nth(top[3])
            add_tag(tag)
            add_c0(len(text))
            s["unseen"].append(raw is not None or tag in _UNSEEN and not unseen)
            sub_end.append(i)
            c1.append(len(text))
            named = {}
            if attrs:
                for name, double, single, bare in _ATTR.findall(attrs):
                    value = double or single or bare
                    named.setdefault(name.lower(), unescape(value) if "&" in value else value)
                if "class" in named:
                    self.classes.extend(named["class"].split())
                self.attr_key.extend(named.keys())
                self.attr_value.extend(named.values())
            add_id(named.get("id"))
            self.class_start.append(len(self.classes))
            self.attr_start.append(len(self.attr_key))
            if raw is not None:
                raws.append((base + i, raw))
            elif tag not in _VOID and not attrs.endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                unseen += tag in _UNSEEN
                stack.append([i, tag, -1, 0])
        close_to(1)
        s["idx"].extend(range(i + 1))
        for at, raw in raws:
            s["c0"][at] = len(text)
            text.append(raw)
            c1[at] = len(text)
        self.chunks.extend(text)
        self.chunk_start.append(len(self.chunks))
        self.page_start.append(len(sub_end))

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        def ints(v):
            return pa.array(v, pa.int32())

        s = self.scalar
        column = {k: ints(s[k]) for k in ("idx", "parent", "depth", "prev", "nth", "sub_end", "c0", "c1")}
        column["unseen"] = pa.array(s["unseen"], pa.bool_())
        column["tag"] = pa.array(s["tag"], pa.string())
        column["id"] = pa.array(s["id"], pa.string())
        column["classes"] = pa.ListArray.from_arrays(ints(self.class_start), pa.array(self.classes, pa.string()))
        column["attrs"] = pa.MapArray.from_arrays(
            ints(self.attr_start), pa.array(self.attr_key, pa.string()), pa.array(self.attr_value, pa.string())
        )
        nodes = pa.StructArray.from_arrays([column[f] for f in NODE_FIELDS], names=NODE_FIELDS)
        dom = pa.ListArray.from_arrays(ints(self.page_start), nodes)
        chunks = pa.ListArray.from_arrays(ints(self.chunk_start), pa.array(self.chunks, pa.string()))
        return dom, chunks


def parse_batches(batches, html: str, kept: list[str]):
    """Arrow batches in, Arrow batches out; long batches leave in pieces of bounded text size."""
    for batch in batches:
        source = batch.column(html)
        start, used, nodes = 0, 0, Nodes()

        def flush(start, stop, nodes):
            dom, chunks = nodes.arrays()
            columns = [batch.column(k).slice(start, stop - start) for k in kept]
            return pa.RecordBatch.from_arrays(columns + [dom, chunks], names=kept + ["dom", "chunks"])

        for i in range(batch.num_rows):
            page = source[i].as_py() or ""
            nodes.add_page(page)
            used += len(page)
            if used >= _SLICE_CHARS:
                yield flush(start, i + 1, nodes)
                start, used, nodes = i + 1, 0, Nodes()
        if start < batch.num_rows:
            yield flush(start, batch.num_rows, nodes)
