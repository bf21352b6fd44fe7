"""Bad markup as browsers read it: which elements are open while a page's tags go by. No tree is kept, so memory is that of the open elements."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

# Kinds of elements, as the HTML standard lists them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSE_P = HEADINGS | set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p pre search section summary ul".split())
SPECIAL = CLOSE_P | VOID | set("applet body button caption colgroup dd dt frame frameset head html iframe keygen li marquee noembed noframes noscript object plaintext script select style table tbody td template textarea tfoot th thead title tr xmp".split())
LIMITS = set("applet caption html marquee object table td template th".split())
BUTTON, LISTS, ITEM_LIMITS = LIMITS | {"button"}, LIMITS | {"ol", "ul"}, SPECIAL - {"address", "div", "p"}
CELLS, SECTIONS = {"td", "th", "caption"}, {"tbody", "thead", "tfoot"}
MARKED = CELLS | {"applet", "marquee", "object", "template"}
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
#: Elements whose text stands apart from what is around them.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video".split())
#: Table parts, and what each of them ends before it starts.
PARTS = {"tr": CELLS | {"tr"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}, "caption": CELLS | SECTIONS | {"tr"}, "colgroup": CELLS | SECTIONS | {"tr"}} | {s: CELLS | SECTIONS | {"tr"} for s in SECTIONS}


class Element:
    """An open element. marks: how long the texts were that were being collected as it began, by their place in Markup.texts."""

    __slots__ = ("tag", "attrs", "classes", "gone", "marks")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.classes = tag, attrs, set(attrs.get("class", "").split())
        self.gone, self.marks = False, ()


class Markup(HTMLParser):
    """Calls begin() and end() as elements open and close, and adds text to the collectors in texts: (depth of the element, pieces).

    Items, paragraphs, headings, options and table parts end where the standard has them end; end tags without open element count for nothing, or
    not beyond the element they stand in; formatting elements that were closed by something else are opened again before the next text; scripts and
    styles are no text, and what looks like tags in a textarea or title is text. Left out: text that stands in a table but in no cell isn't moved
    before the table, and copies of formatting elements inside blocks that were open when they ended are not found as elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.again: list[Element | None] = []  # formatting elements to open again; None: those before stay outside
        self.texts: list[tuple[int, list[str]]] = []
        self.quirks = True

    def begin(self, element: Element) -> None:
        """A new element, at depth len(self.open)."""

    def end(self) -> None:
        """Elements from depth len(self.open) on have ended."""

    def handle_decl(self, decl: str) -> None:
        if decl.lower().split()[:2] == ["doctype", "html"]:
            self.quirks = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "head" or tag in ("html", "body", "form") and any(e.tag == tag for e in self.open):
            return
        if tag in PARTS or tag == "col":
            if self.within({"table"}, {"template"}) is None:
                return
            self.close_parts(PARTS.get(tag, CELLS | {"tr"}))
        elif tag in ("li", "dd", "dt"):
            self.close_item({"li"} if tag == "li" else {"dd", "dt"})
        elif tag in ("option", "optgroup"):
            for kind in ("option", tag):
                if self.open and self.open[-1].tag == kind:
                    self.pop_to(len(self.open) - 1)
        if (tag in CLOSE_P or tag in ("li", "dd", "dt", "plaintext", "xmp") or tag == "table" and not self.quirks) and tag not in PARTS:
            self.close_tag("p", BUTTON)
        if tag in HEADINGS and self.open and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if tag == "button":
            self.close_tag("button", LIMITS)
        if tag == "a" and any(e.tag == "a" for e in self.live()):
            self.end_formatting("a")
        if tag not in CLOSE_P and tag not in PARTS and tag not in ("li", "dd", "dt", "table", "script", "style", "html", "body", "title", "textarea", "source", "track", "param"):
            self.reopen()
        if tag == "nobr" and self.within({"nobr"}, LIMITS) is not None:
            self.end_formatting("nobr")
        element = Element(tag, a)
        self.push(element)
        if tag in FORMATTING:
            same = [e for e in self.live() if (e.tag, e.attrs) == (tag, a)]
            if len(same) == 3:
                self.again.remove(same[0])
            self.again.append(element)
        elif tag in MARKED:
            self.again.append(None)
        if tag in ("textarea", "title") and not hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS"):
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in SPECIAL | FORMATTING | {"span", "label", "select", "option"} and self.open and self.open[-1].tag == tag:
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.apart()
        elif tag == "p":
            if not self.close_tag("p", BUTTON):
                self.apart()
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in ("html", "body", "head"):
            return
        elif tag in HEADINGS:
            at = self.within(HEADINGS, LIMITS)
            if at is not None:
                self.pop_to(at)
        elif tag in PARTS or tag == "table":
            at = self.within({tag}, {"table", "template"})
            if at is not None:
                self.pop_to(at)
        elif tag in CLOSE_P or tag in MARKED or tag in ("li", "dd", "dt", "button"):
            self.close_tag(tag, LISTS if tag == "li" else LIMITS)
        else:
            self.end_other(tag)

    def handle_data(self, data: str) -> None:
        inside = self.open[-1].tag if self.open else ""
        if inside in ("script", "style"):
            return
        if inside in ("textarea", "title") and self.cdata_elem and not hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS"):
            data = unescape(data)
        elif inside not in ("textarea", "title", "table", "tr", *SECTIONS):
            self.reopen()
        for _, found in self.texts:
            found.append(data)

    def apart(self) -> None:
        for _, found in self.texts:
            found.append(" ")

    def push(self, element: Element) -> None:
        if element.tag in BLOCKS:
            self.apart()
        if element.tag in SPECIAL:
            element.marks = [(found, len(found)) for depth, found in self.texts if self.open[depth].tag in FORMATTING]
        self.begin(element)
        if element.tag not in VOID:
            self.open.append(element)

    def pop_to(self, depth: int) -> None:
        """Ends all elements from that depth on."""
        while len(self.open) > depth:
            last = self.open.pop()
            if last.tag in BLOCKS:
                self.apart()
            if last.tag in MARKED and None in self.again:
                while self.again.pop() is not None:
                    pass
        while self.texts and self.texts[-1][0] >= depth:
            self.texts.pop()
        self.end()

    def within(self, tags: set[str], limits: set[str]) -> int | None:
        """The depth of the innermost open element of these, if no limit stands between."""
        for i in range(len(self.open) - 1, -1, -1):
            if not self.open[i].gone:
                if self.open[i].tag in tags:
                    return i
                if self.open[i].tag in limits:
                    return None
        return None

    def close_tag(self, tag: str, limits: set[str]) -> bool:
        at = self.within({tag}, limits)
        if at is not None:
            self.pop_to(at)
        return at is not None

    def close_item(self, tags: set[str]) -> None:
        at = self.within(tags, ITEM_LIMITS)
        if at is not None:
            self.pop_to(at)

    def close_parts(self, tags: set[str]) -> None:
        """Ends the outermost of these parts inside the innermost table, and what lies open in the table if there is none."""
        table = self.within({"table"}, {"template"}) or 0
        at = next((i for i in range(table + 1, len(self.open)) if self.open[i].tag in tags), None)
        if at is not None:
            self.pop_to(at)

    def end_other(self, tag: str) -> None:
        at = self.within({tag}, SPECIAL)
        if at is not None:
            self.pop_to(at)

    def live(self) -> list[Element]:
        """Formatting elements since the last mark."""
        from_ = max((i for i, e in enumerate(self.again) if e is None), default=-1) + 1
        return self.again[from_:]

    def reopen(self) -> None:
        """Opens again what was closed by something else than its own end tag."""
        if not self.again or self.again[-1] is None or any(e is self.again[-1] for e in reversed(self.open)):
            return
        here = {id(e) for e in self.open}
        live = self.live()
        first = max((i for i, e in enumerate(live) if id(e) in here), default=-1) + 1
        for i in range(len(self.again) - len(live) + first, len(self.again)):
            self.again[i] = Element(self.again[i].tag, self.again[i].attrs)
            self.push(self.again[i])

    def end_formatting(self, tag: str) -> None:
        """A formatting element's end tag. If blocks were opened inside it, it ends where the first of them began, and they stay open."""
        last = next((e for e in reversed(self.live()) if e.tag == tag), None)
        if last is None:
            self.end_other(tag)
            return
        at = next((i for i, e in enumerate(self.open) if e is last), None)
        if at is not None and any(e.tag in LIMITS for e in self.open[at + 1 :]):
            return
        self.again = [e for e in self.again if e is not last]
        if at is None:
            return
        block = next((e for e in self.open[at + 1 :] if e.tag in SPECIAL), None)
        if block is None:
            self.pop_to(at)
            return
        last.gone = True
        own = {id(found): found for depth, found in self.texts if depth == at}
        for found, length in block.marks:
            if id(found) in own:
                del found[length:]
        self.texts = [(depth, found) for depth, found in self.texts if depth != at]
