"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

Method: whatever the language, a page becomes one tree. Wiki, Markdown and LaTeX are brought
to tags first; a tree builder supplies implied tags and visibility rules; a layout renderer
emits all visible text with block spacing, list markers, aligned table cells, fenced code and
formulas between dollar signs. The kinds of structure are read off the visible tree.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import table

# Element names by what the tree builder and the renderer do with them.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption syntaxhighlight source poem".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr ref references nowiki noinclude includeonly onlyinclude gallery mi mn mo mrow mfrac msup msub msqrt semantics annotation input button select option textarea iframe object embed video audio canvas svg path head title meta link style script noscript template base col colgroup area map section pages blockquote".split())
KNOWN = BLOCKS | INLINE
VOID = set("area base br col embed hr img input link meta source wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "nowiki"}
HIDDEN = {"head", "script", "style", "title", "noscript", "template", "nav", "footer", "iframe", "object", "svg", "canvas", "ref", "references", "select", "input"}
HIDDEN_CLASS = re.compile(r"(?:^|\s)(?:ws-noexport|noprint|navbox|navigation|toc|mw-editsection|pagenum|catlinks|metadata|sr-only|visually-hidden|breadcrumb|sidebar|menu)(?:\s|$)", re.I)
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = {f"h{n}" for n in range(1, 7)}

ATTR = r"""\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<!doctype[^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:{ATTR})*+)\s*/?\s*>", re.S | re.I)
ATTRS = re.compile(r"""([A-Za-z_:@][\w:.@-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
ESCAPED = re.compile(r"&lt;/?[A-Za-z](?:(?!&[lg]t;)[^\n])*&gt;|&lt;!--(?:(?!&lt;!--|--&gt;).)*--&gt;", re.S)


def _tags(text: str):
    """Matches of real tags and comments; other angle brackets are text."""
    at = 0
    while (at := text.find("<", at)) >= 0:
        m = TAG.match(text, at)
        if m and (m.group(2) is None or m.group(2).lower() in KNOWN):
            yield m
            at = m.end()
        else:
            at += 1


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden")

    def __init__(self, tag: str, attrs: dict, hidden: bool):
        self.tag, self.attrs, self.children, self.hidden = tag, attrs, [], hidden


def _attrs(source: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRS.findall(source)} if source else {}


def _hidden(tag: str, attrs: dict) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return tag in HIDDEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or attrs.get("aria-hidden") == "true" and tag != "img" or bool(attrs.get("class") and HIDDEN_CLASS.search(attrs["class"]))


def build_tree(source: str) -> Node:
    """The tree of an HTML text: implied end tags supplied, stray end tags dropped."""
    root = Node("root", {}, False)
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close_to(names: set, stop: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    for m in _tags(source):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].children.append(m.group()[9:-3])
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in HEADINGS and stack[k].tag in HEADINGS):
                    del stack[k:]
                    break
            continue
        if tag in CLOSED_BY:
            close_to(*CLOSED_BY[tag])
        elif tag in BLOCKS:
            close_to({"p"}, {"table", "td", "li", "div", "blockquote", "section"})
            if tag in HEADINGS:
                close_to(HEADINGS, {"div", "section", "td", "li"})
        attrs = _attrs(m.group(3))
        node = Node(tag, attrs, stack[-1].hidden or _hidden(tag, attrs))
        stack[-1].children.append(node)
        if tag in VOID or m.group().endswith("/>"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            if tag == "nowiki":
                stack[-1].children[-1] = html.unescape(inner)
            else:
                node.children.append(inner)
            at = end.end() if end else len(source)
            continue
        stack.append(node)
    text(source[at:])
    return root


def formula_of(node: Node) -> str | None:
    """The formula an element stands for, if it is one."""
    if node.tag == "math":
        inner = node.children[0] if node.children and isinstance(node.children[0], str) else ""
        return html.unescape(node.attrs.get("alttext") or re.sub(r"<[^<>]*>", "", inner)).strip()
    if node.tag == "img" and re.search(r"(?:^|[\s-])(?:math|tex|latex|equation)", node.attrs.get("class", ""), re.I):
        return node.attrs.get("alt", "").strip()
    return None


CODE_TAGS = {"code", "pre", "kbd", "samp", "tt", "syntaxhighlight"}
TEXT_FORMULA = re.compile(r"\$\$(?=\S)[^$]+?(?<=\S)\$\$|\\\((?:(?!\\\)).)+?\\\)|\\\[(?:(?!\\\]).)+?\\\]|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={}+])[^$\n]+(?<=[^\s\\])\$(?![\d\w$])|(?<![\\$\w])\$[A-Za-z]\$(?![\w$])", re.S)


def render(root: Node) -> tuple[str, set[str]]:
    """(text, kinds) of the visible tree."""
    kinds: set[str] = set()
    sinks: list[list[str]] = [[]]
    lists: list[list] = []
    tables: list[list[list[str]]] = []
    pre, stack = 0, [("in", root)]
    put = lambda s: sinks[-1].append(s)
    while stack:
        what, node = stack.pop()
        if what == "text":
            if pre:
                put("\x01" + node.replace("\n", "\x02").replace(" ", "\x03").replace("\t", "\x03\x03"))
            else:
                if TEXT_FORMULA.search(node):
                    kinds.add("formula")
                put(re.sub(r"[ \t\r\f\v\n]+", " ", node))
            continue
        tag = node.tag
        if what == "in":
            if node.hidden:
                continue
            formula = formula_of(node)
            if formula is not None:
                kinds.add("formula")
                put(f"${formula}$" if formula else "")
                continue
            if tag in HEADINGS:
                put("\n\n" + "#" * int(tag[1]) + " ")
                sinks.append([])
            elif tag in ("ul", "ol", "menu", "dl"):
                lists.append([tag, 0])
                put("\n\n" if len(lists) == 1 else "")
            elif tag in ("li", "dd", "dt"):
                sinks.append([])
            elif tag in CODE_TAGS:
                sinks.append([])
                pre += 1
            elif tag in ("table",):
                tables.append([])
                sinks.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                sinks.append([])
            elif tag == "br":
                put("\n")
            elif tag == "hr":
                put("\n\n---\n\n")
            elif tag == "img" and node.attrs.get("alt"):
                put(node.attrs["alt"])
            elif tag in BLOCKS:
                put("\n\n" if tag != "tr" else "\n")
            stack.append(("out", node))
            stack.extend(("text", c) if isinstance(c, str) else ("in", c) for c in reversed(node.children))
            continue
        if tag in HEADINGS:
            inner = " ".join(_tidy(sinks.pop()).split())
            if inner:
                kinds.add("heading")
                put(inner + "\n\n")
            else:
                sinks[-1].pop()
        elif tag in ("ul", "ol", "menu", "dl"):
            lists.pop()
            put("\n\n" if not lists else "")
        elif tag in ("li", "dd", "dt"):
            inner = _tidy(sinks.pop())
            kind = lists[-1] if lists else ["ul", 0]
            kind[1] += 1
            if inner:
                kinds.add("list")
                mark = f"{kind[1]}. " if kind[0] == "ol" else "" if tag == "dt" else "- "
                pad = "  " * max(0, len(lists) - 1)
                put("\n" + pad + mark + re.sub(r"\n+", "\n" + pad + "  ", inner).replace("\n" + pad + "    ", "\n" + pad + "  "))
        elif tag in CODE_TAGS:
            pre -= 1
            raw = "".join(sinks.pop())
            if raw.strip("\x01\x02\x03\n "):
                kinds.add("code")
                if pre:
                    put(raw)
                elif tag in ("pre", "syntaxhighlight") or "\x02" in raw:
                    put("\n\n\x01```\x02" + raw.strip("\n\x02") + "\x02```\n\n")
                else:
                    put("\x01`" + raw + "\x01`")
        elif tag == "table":
            rest = _tidy(sinks.pop())
            put("\n\n" + (rest + "\n" if rest else "") + _align(tables.pop()) + "\n\n")
        elif tag in ("td", "th") and tables:
            cell = " ".join(_tidy(sinks.pop()).split())
            (tables[-1] or tables[-1].append([]) or tables[-1])[-1].append((cell, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag in BLOCKS and tag != "tr":
            put("\n\n")
    return _tidy(sinks[0]).replace("\x01", "").replace("\x02", "\n").replace("\x03", " "), kinds


def _span(node: Node, name: str, most: int) -> int:
    """How many columns or rows a cell takes (``most`` is the language's own limit); what is no number is 1."""
    stated = node.attrs.get(name, "").strip()
    return min(max(int(stated), 1), most) if stated.isascii() and stated.isdigit() else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells at their columns: what a cell spans beside and below it stays blank."""
    covered: dict[int, int] = {}
    out = []
    for row in rows:
        line: list[str] = []
        for text, columns, below in row:
            while covered.get(len(line)):
                covered[len(line)] -= 1
                line.append("")
            for k in range(columns):
                covered[len(line)] = below - 1
                line.append("" if k else text)
        while covered.get(len(line)):
            covered[len(line)] -= 1
            line.append("")
        out.append(line)
    return out


def _align(cells: list[list[tuple[str, int, int]]]) -> str:
    """Table rows with their cells padded to columns."""
    rows = _grid(cells)
    widths: list[int] = []
    for r in rows:
        for k, c in enumerate(r):
            widths[k : k + 1] = [max(len(c), widths[k] if k < len(widths) else 0)]
    return "\n".join(" | ".join(c.ljust(widths[k]) for k, c in enumerate(r)).rstrip().replace("  ", "\x03\x03") for r in rows if r)


def _tidy(parts: list[str]) -> str:
    s = "".join(parts)
    s = re.sub(r" *\n *", "\n", re.sub(r"[ \xa0]{2,}", " ", s)) if "\n  " not in s else re.sub(r" +\n", "\n", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip(" \n")


# --- other languages to tags -------------------------------------------------------------

WIKI_INLINE = re.compile(r"'{2,5}[^'\n]|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|\[https?://\S+ [^\]\n]+\]|\{\|", re.S)
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*(?=[^=\s])(.+?)[ \t]*\1[ \t]*$", re.M)
WIKI_TAG = re.compile(r"<(?:ref|math|syntaxhighlight|nowiki|noinclude|references|poem|pages)\b", re.I)
TEX_COMMAND = re.compile(r"\\(?:(?:sub)*section|chapter|part|paragraph|emph|text[a-z]{2,}|footnote|item|begin|end|og|fg|cite|ref|label|url|href|verb|it|bf|sc|em|maketitle|documentclass|usepackage|author|title|date|par|newline|noindent|ldots|dots|quad|hspace|vspace|guillemotleft|oe|ae|aa|ss|&)(?![A-Za-z])|\\[A-Za-z]+\*?\{|\\[`'^\"~c]\{?[A-Za-z]|\{\\[a-z]+ |\\[,;!&%$#_]")
MD_BLOCK = re.compile(r"^ {0,3}#{1,6} +\S|^ {0,3}(?:```|~~~)|^ {0,3}> ?\S|^.*\S.*\n {0,3}(?:={3,}|-{3,}) *$|^.*\|.*\n\|?(?: *:?-{2,}:? *\|)+(?: *:?-{2,}:? *)?$", re.M)
MD_INLINE = re.compile(r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+(?<=\S)~~|!?\[[^\]\n]+\]\([^)\s]+(?: \"[^\"\n]*\")?\)|\[\^[^\]\s]+\]|`[^`\n]+`|(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])|^\[[^\]]+\]: \S+", re.M)
LIST_LINE = re.compile(r"^ {0,7}(?:[*+-]|\d{1,4}[.)]) +(?![*+-] )\S", re.M)
RULE = re.compile(r"^ {0,3}(?:\* ?){3,}$|^ {0,3}(?:- ?){3,}$|^ {0,3}(?:_ ?){3,}$")


def language_of(text: str) -> str:
    """'html', 'wiki', 'latex', 'markdown' or 'plain' (signs that merely look like markup are none)."""
    names = {m.group(2).lower() if m.group(2) else "!" for m in _tags(text)} if "<" in text else set()
    wiki = WIKI_HEADING.search(text) or WIKI_INLINE.search(text) or WIKI_TAG.search(text)
    if names & (BLOCKS - {"pre", "syntaxhighlight", "source", "poem"}):
        return "html"
    if wiki and not (names & {"a", "span", "i", "b", "em", "strong"} and not WIKI_INLINE.search(text)):
        return "wiki"
    if names - {"code", "pre"}:
        return "html"
    bare = TEXT_FORMULA.sub("", text)
    if TEX_COMMAND.search(bare):
        return "latex"
    if MD_BLOCK.search(text) or MD_INLINE.search(bare) or len(LIST_LINE.findall(text)) > 1:
        return "markdown"
    if names or REFERENCE.search(text):
        return "html"
    if re.search(r"\\[(\[]", text) and TEXT_FORMULA.search(text):
        return "latex"
    if TEXT_FORMULA.search(text) or re.search(r"\n\n {4}\S", text):
        return "markdown"
    return "plain"


def _esc(s: str) -> str:
    return html.escape(s, quote=False)


def _paragraphs(lines: list[str]) -> list[str]:
    """Plain lines as paragraphs parted at blank lines; lines that hold block tags pass."""
    out, held = [], []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
        elif held:
            out.append("<p>" + "\n".join(held) + "</p>")
            held = []
    return out


def _nested(items: list[tuple[str, str]]) -> str:
    """List items given by their markers ('*#') as nested lists."""
    out, open_ = [], ""
    for mark, body in items:
        same = 0
        while same < min(len(mark), len(open_)) and (mark[same] == "#") == (open_[same] == "#"):
            same += 1
        out.extend("</ol>" if c == "#" else "</ul>" for c in reversed(open_[same:]))
        out.extend("<ol>" if c == "#" else "<ul>" for c in mark[same:])
        out.append(f"<li>{body}</li>")
        open_ = mark
    out.extend("</ol>" if c == "#" else "</ul>" for c in reversed(open_))
    return "".join(out)


def _inline_wiki(s: str) -> str:
    s = re.sub(r"\[\[(?:Cat[ée]gorie|Category|Fichier|File|Image):[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", s)
    for _ in range(4):
        s = re.sub(r"\{\{(?:page|nop|Titre|Auteur|Navigation|\w+Nav)\|?[^{}]*\}\}", "", s)
        s = re.sub(r"\{\{[^{}|]*\|(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", s)
        s = re.sub(r"\{\{[^{}|]*\}\}", "", s)
    s = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", s)
    return re.sub(r"'{2,5}", "", s)


def _protected(text: str, pattern: str, as_tag) -> tuple[str, list[str]]:
    """Take spans out of the reach of inline rules; they come back by number."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(as_tag(m))
        return f"\x04{len(held) - 1}\x05"

    return re.sub(pattern, keep, text, flags=re.S | re.I | re.M), held


def _restored(s: str, held: list[str]) -> str:
    return re.sub(r"\x04(\d+)\x05", lambda m: held[int(m.group(1))], s)


def wiki_to_html(text: str) -> str:
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)

    def tag(m: re.Match) -> str:
        name = m.group(1).lower()
        return f"<{name}{m.group(2)}>{_esc(html.unescape(m.group(3)))}</{name}>"

    text, held = _protected(text, r"<(math|code|pre|syntaxhighlight|source|nowiki)\b((?:\s[^<>]*)?)>(.*?)</\1\s*>", tag)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", "", text, flags=re.S | re.I)
    out: list[str] = []
    lines, k = text.split("\n"), 0
    plain: list[str] = []
    while k < len(lines):
        line = lines[k]
        heading = WIKI_HEADING.match(line)
        item = re.match(r"([*#:;]+)[ \t]*(.*\S.*)", line)
        if heading or item or line.startswith("{|") or (line.startswith(" ") and line.strip()):
            out.extend(_paragraphs(plain))
            plain = []
        if heading:
            n = len(heading.group(1))
            out.append(f"<h{n}>{_inline_wiki(heading.group(2))}</h{n}>")
        elif item:
            items = []
            while k < len(lines) and (item := re.match(r"([*#:;]+)[ \t]*(.*\S.*)", lines[k])):
                items.append((item.group(1), _inline_wiki(item.group(2))))
                k += 1
            if all(set(m) <= {":"} for m, _ in items):
                out.extend(f"<p>{b}</p>" for _, b in items)
            else:
                out.append(_nested(items))
            continue
        elif line.startswith("{|"):
            rows: list[list[str]] = [[]]
            k += 1
            while k < len(lines) and not lines[k].startswith("|}"):
                cell = lines[k]
                if cell.startswith("|-"):
                    rows.append([])
                elif cell[:1] in "|!" and not cell.startswith("|+"):
                    rows[-1].extend(c.rpartition("|")[2] if "[[" not in c else c for c in re.split(r"\|\||!!", cell[1:]))
                k += 1
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_inline_wiki(c.strip())}</td>" for c in r) + "</tr>" for r in rows if r) + "</table>")
        elif line.startswith(" ") and line.strip():
            held_lines = []
            while k < len(lines) and lines[k].startswith(" ") and lines[k].strip():
                held_lines.append(_esc(lines[k][1:]))
                k += 1
            out.append("<pre>" + "\n".join(held_lines) + "</pre>")
            continue
        else:
            plain.append(_inline_wiki(line))
        k += 1
    out.extend(_paragraphs(plain))
    return _restored("\n".join(out), held)


def _inline_md(s: str) -> str:
    s = re.sub(r"!?\[([^\]\n]+)\]\([^)\s]+(?: \"[^\"\n]*\")?\)", r"\1", re.sub(r"\[\^[^\]\s]+\]:?", "", s))
    s = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=\S)([^_\n]+?)(?<=\S)__(?!\w)|~~(?=\S)([^~\n]+?)(?<=\S)~~", lambda m: m.group(1) or m.group(2) or m.group(3), s)
    return re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])", lambda m: m.group(1) or m.group(2), s)


def _formula_tag(m: re.Match) -> str:
    return "<math>" + _esc(re.sub(r"^(?:\$\$?|\\[(\[])|(?:\$\$?|\\[)\]])$", "", m.group()).strip()) + "</math>"


def markdown_to_html(text: str) -> str:
    text, held = _protected(text, r"^ {0,3}(```+|~~~+)[^\n]*\n(.*?)(?:^ {0,3}\1[`~]* *$|\Z)", lambda m: f"<pre>{_esc(m.group(2))}</pre>")
    text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", lambda m: held.append(f"<code>{_esc(m.group(1))}</code>") or f"\x04{len(held) - 1}\x05", text)
    text = TEXT_FORMULA.sub(lambda m: held.append(_formula_tag(m)) or f"\x04{len(held) - 1}\x05", text)
    out: list[str] = []
    plain: list[str] = []
    lines, k = text.split("\n"), 0

    def flush() -> None:
        out.extend(_paragraphs(plain))
        plain.clear()

    item_of = re.compile(r"( {0,11})([*+-]|\d{1,4}[.)]) +(\S.*)")
    while k < len(lines):
        line = lines[k]
        atx = re.match(r" {0,3}(#{1,6}) +(.*?)(?: +#+)? *$", line)
        under = k + 1 < len(lines) and line.strip() and not plain and re.match(r" {0,3}(={3,}|-{3,}) *$", lines[k + 1])
        if atx and atx.group(2).strip():
            flush()
            n = len(atx.group(1))
            out.append(f"<h{n}>{_inline_md(atx.group(2))}</h{n}>")
        elif under and not item_of.match(line):
            flush()
            n = 1 if under.group(1)[0] == "=" else 2
            out.append(f"<h{n}>{_inline_md(line.strip())}</h{n}>")
            k += 1
        elif RULE.match(line):
            flush()
            out.append("<hr>")
        elif item_of.match(line):
            flush()
            items = []
            while k < len(lines) and ((m := item_of.match(lines[k])) or (lines[k].startswith("  ") and lines[k].strip())):
                if m:
                    items.append((("#" if m.group(2)[0].isdigit() else "*") * (1 + len(m.group(1)) // 2), _inline_md(m.group(3))))
                else:
                    items[-1] = (items[-1][0], items[-1][1] + " " + _inline_md(lines[k].strip()))
                k += 1
            out.append(_nested(items))
            continue
        elif re.match(r" {4}\S", line) and not plain:
            held_lines = []
            while k < len(lines) and (lines[k].startswith("    ") or not lines[k].strip() and k + 1 < len(lines) and lines[k + 1].startswith("    ")):
                held_lines.append(_esc(lines[k][4:]))
                k += 1
            out.append("<pre>" + "\n".join(held_lines) + "</pre>")
            continue
        elif re.match(r" {0,3}>", line):
            flush()
            quoted = []
            while k < len(lines) and re.match(r" {0,3}>", lines[k]):
                quoted.append(_inline_md(re.sub(r"^ {0,3}> ?", "", lines[k])))
                k += 1
            out.append("<blockquote>" + "\n".join(_paragraphs(quoted)) + "</blockquote>")
            continue
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\|?(?: *:?-{2,}:? *\|)+(?: *:?-{2,}:? *)?$", lines[k + 1]):
            flush()
            rows = []
            while k < len(lines) and "|" in lines[k]:
                if not re.match(r"^[|: -]+$", lines[k]):
                    rows.append([c.strip() for c in lines[k].strip().strip("|").split("|")])
                k += 1
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_inline_md(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            continue
        elif re.match(r"\[[^\]]+\]: \S+", line):
            pass
        else:
            plain.append(line)
        k += 1
    flush()
    return _restored("\n".join(_inline_md(b) if b.startswith("<p>") else b for b in out), held)


TEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
TEX_ACCENT = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327"}
TEX_SIGN = {"og": "«\u00a0", "fg": "\u00a0»", "ldots": "…", "dots": "…", "oe": "œ", "ae": "æ", "ss": "ß", "guillemotleft": "«", "guillemotright": "»", "par": "\n\n", "newline": "\n", "quad": " ", "noindent": ""}


def latex_to_html(text: str) -> str:
    import unicodedata

    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    text, held = _protected(text, r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{\1\*?\}", lambda m: f"<pre>{_esc(m.group(2).strip(chr(10)))}</pre>")
    text = re.sub(r"\\(?:verb|lstinline)\*?([^\sA-Za-z{])(.*?)\1", lambda m: held.append(f"<code>{_esc(m.group(2))}</code>") or f"\x04{len(held) - 1}\x05", text)
    text = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)\*?\}(.*?)\\end\{\1\*?\}", lambda m: held.append(f"<math>{_esc(m.group(2).strip())}</math>") or f"\x04{len(held) - 1}\x05", text, flags=re.S)
    text = TEXT_FORMULA.sub(lambda m: held.append(_formula_tag(m)) or f"\x04{len(held) - 1}\x05", text)
    text = re.sub(r"\\([`'^\"~])\s*\{?\\?([A-Za-zı])\}?|\\c\{([A-Za-z])\}", lambda m: unicodedata.normalize("NFC", (m.group(2) or m.group(3)) + TEX_ACCENT[m.group(1) or "c"]), text)
    text = re.sub(r"\\(?:footnote|label|cite|ref|index|vspace|hspace|documentclass|usepackage|pagestyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = _esc(text)
    for _ in range(5):
        text = re.sub(r"\\(part|chapter|(?:sub)*section|paragraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", lambda m: f"\n\n\x06h{TEX_LEVEL[m.group(1)]}\x07{m.group(2)}\x06/h{TEX_LEVEL[m.group(1)]}\x07\n\n", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(?!(?:begin|end|item|og|fg)(?![A-Za-z]))[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\{\\[a-zA-Z]+\s+([^{}]*)\}", r"\1", text)
        text = re.sub(r"\{([^{}\\]*)\}(?<!begin\})", lambda m: m.group() if m.string[max(0, m.start() - 6) : m.start()].endswith(("\\begin", "\\end")) else m.group(1), text)
    text = re.sub(r"\\begin\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?", lambda m: "\n\n\x06" + ("ol" if m.group(1) == "enumerate" else "ul") + "\x07", text)
    text = re.sub(r"\\end\{(itemize|enumerate|description)\}", lambda m: "\x06/" + ("ol" if m.group(1) == "enumerate" else "ul") + "\x07\n\n", text)
    text = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?", lambda m: "\x06li\x07" + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*", "\n\n", text)
    text = re.sub(r"\\([A-Za-z]+)\*?(?:\s+|(?![A-Za-z]))(?:\{\})?", lambda m: TEX_SIGN.get(m.group(1), ""), text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\\[,;: ]", " ", text)
    text = re.sub(r"\\([!-/\[-`{-~])", lambda m: "" if m.group(1) in "!/-" else m.group(1), text).replace("~", "\u00a0").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    text = text.replace("\x06", "<").replace("\x07", ">")
    parts = re.split(r"\n[ \t]*\n+", text)
    return _restored("\n".join(p if re.match(r"\s*<(?:h\d|/?[uo]l)", p) else f"<p>{p}</p>" for p in parts if p.strip()), held)


def convert(text: str | None) -> tuple[str | None, str | None, list[str]]:
    """(clean text, language, kinds of structure). NULL gives NULLs; plain text comes out as it is."""
    if text is None:
        return None, None, []
    if "\x00" <= min(text, default="a") <= "\x07":
        text = re.sub("[\x00-\x07]", "", text)
    if "&lt;" in text and not any(True for _ in _tags(text)) and ESCAPED.search(text):
        text = html.unescape(text)
    language = language_of(text)
    if language == "plain":
        return text, language, []
    if language == "html" and not any(m.group(2) and m.group(2).lower() in BLOCKS | {"br"} for m in _tags(text)) and "\n\n" in text:
        text = "\n".join(_paragraphs(text.split("\n")))
    to_html = {"html": lambda s: s, "wiki": wiki_to_html, "markdown": markdown_to_html, "latex": latex_to_html}
    clean, kinds = render(build_tree(to_html[language](text)))
    return clean, language, sorted(kinds)


CONVERTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("language", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(CONVERTED)
def convert_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(t) for t in s], columns=["text", "language", "kinds"])


#: Without one of these signs a text holds no markup; it never leaves the JVM.
SIGNS = r"""[<&\\*_~`=\[{$#>]|''|(?m)^\|?(?: *:?-{2,}:? *\|)|(?m)^ *(?:[+-]|\d+[.)]) |\n\n {4}\S|(?m)^-{3,} *$"""


def convert_column(text: Column) -> Column:
    """Struct (text, language, kinds) of a column; texts without any sign of markup skip Python."""
    plain = F.struct(text.alias("text"), F.when(text.isNotNull(), F.lit("plain")).alias("language"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(SIGNS), convert_udf(text)).otherwise(plain)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose field holds markup, and the kinds of structure in the content of pages."""
    titles = table(spark, sf_dir, "chapter").select(F.lit("chapter").alias("origin"), F.col("chapter_id").alias("row_id"), F.col("title").alias("t"))
    pages = table(spark, sf_dir, "resolved").select(F.lit("resolved").alias("origin"), F.col("resolved_id").alias("row_id"), F.col("html").alias("t"))
    rows = titles.unionByName(pages).filter(F.col("t").rlike(SIGNS)).select("origin", "row_id", convert_udf("t").alias("c"))
    rows = rows.filter(F.col("c.language") != "plain")
    kinds = F.concat(F.array(F.lit("markup")), F.when(F.col("origin") == "resolved", F.col("c.kinds")).otherwise(F.array().cast("array<string>")))
    return rows.select("origin", "row_id", F.explode(kinds).alias("kind")).distinct()


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's clean text, with its language and structure."""
    pages = table(spark, sf_dir, "resolved").select("resolved_id", convert_column(F.col("html")).alias("c"))
    return pages.select("resolved_id", F.col("c.text").alias("text"), F.col("c.language").alias("language"), F.array_join("c.kinds", ",").alias("kinds"))


def p1_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's clean title on one line."""
    titles = table(spark, sf_dir, "chapter").select("chapter_id", convert_column(F.col("title")).alias("c"))
    one = F.trim(F.regexp_replace(F.regexp_replace("c.text", r"\s+", " "), r"^#+ ", ""))
    return titles.select("chapter_id", F.when(F.col("c.language") == "plain", F.col("c.text")).otherwise(one).alias("title"), F.col("c.language").alias("language"))
