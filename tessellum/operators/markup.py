"""Wiki markup to pages and node tables.

The parser works on one text at a time inside ``mapInPandas``; it has no counterpart among
built-in functions.  A node row is (page_id, node_id, parent_id, depth, kind, heading,
heading_id, level, para_id, text, links); node ids count in reading order, so a subtree is an
interval.  Rules of templates are data (see ``DEFAULT_TEMPLATES``) and can be overridden.

Defined results: a null or blank text gives a page without nodes; broken markup stays as text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Template names (lower case) by what they leave.
LISTS = (
    "bulleted list", "blist", "bulleted", "ulist", "unordered list", "unbulleted list", "ubl", "ubt", "ublist", "unbullet", "plainlist",
    "ordered list", "hlist", "flatlist",
)
FIRST = (
    "small", "smaller", "midsize", "larger", "big", "large", "huge", "resize", "smallcaps", "sc1", "smallcaps2", "sc2", "sc", "allcaps", "caps",
    "nocaps", "linktext", "cardinal to word", "number to word", "ordinal to word", "nowrap", "mvar", "format price", "visible anchor", "quotation",
    "cquote",
)
SECOND = (
    "lang", "rtl-lang", "transl", "inflation",
)
PAIRS = (
    "convert", "cvt",
)
DROPPED = (
    "citation needed", "respell", "ref", "refn", "r", "zh", "sfn",
)
# list: its arguments as list items; first/second: that argument; pair: two arguments with a blank; drop: nothing; else a text with {{#n}} for argument n.
# Templates without a rule are dropped; an argument alt= wins over dropping.
DEFAULT_TEMPLATES = {name: rule for rule, names in (("list", LISTS), ("first", FIRST), ("second", SECOND), ("pair", PAIRS), ("drop", DROPPED)) for name in names} | {"as of": "as of", "time ago": "time ago", "angbr": "⟨{{#1}}⟩"}
DROPPED_TAGS = "ref|sub|sup|gallery|timeline|references"
PAGE = "page_id string, page_name string, page_type string, redirect string, categories array<string>"
LINK = "struct<target: string, section: string, target_id: string, anchor: string>"
NODE = f"page_id string, node_id int, parent_id int, depth int, kind string, heading string, heading_id string, level int, para_id string, text string, links array<{LINK}>"


@dataclass
class Config:
    site: str = "wiki"
    templates: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_TEMPLATES))
    category: str = "category:"
    disambiguation_suffix: str = "(disambiguation)"
    images: tuple[str, ...] = ("file:", "image:")


def page_id(name: str, config: Config) -> str:
    return config.site + ":" + quote(name, safe="()/,.-_~!*'")


def normal_name(name: str) -> str:
    name = " ".join(name.replace("_", " ").split())
    return name[:1].upper() + name[1:]


def clean(text: str) -> str:
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    text = re.sub(rf"<({DROPPED_TAGS})\b[^>]*/>", "", text, flags=re.I)
    text = re.sub(rf"<({DROPPED_TAGS})\b[^>]*>.*?</\1\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"</?[a-zA-Z][^<>]*>", "", text)
    return re.sub(r"'{2,5}", "", text)


def split_arguments(body: str) -> list[str]:
    """Parts between bars outside of brackets and braces."""
    out, depth, part, i = [], 0, [], 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("[[", "{{"):
            depth += 1
        elif two in ("]]", "}}"):
            depth -= 1
        if two in ("[[", "{{", "]]", "}}"):
            part.append(two)
            i += 2
            continue
        if body[i] == "|" and depth == 0:
            out.append("".join(part))
            part = []
        else:
            part.append(body[i])
        i += 1
    return [*out, "".join(part)]


def expand(rule: str, plain: list[str], named: dict[str, str]) -> str:
    """What a template leaves by its rule; too few arguments leave nothing."""
    at = lambda i: plain[i] if i < len(plain) else ""
    match rule:
        case "drop":
            return named.get("alt", "")
        case "first":
            return at(0)
        case "second":
            return at(1)
        case "list":
            return "".join(f"\n* {p}" for p in plain) + "\n"
        case "pair":
            return f"{plain[0]} {plain[1]}" if len(plain) > 1 else ""
        case "as of":
            if not 1 <= len(plain) <= 3:
                return ""
            lead = "since" if named.get("since") == "y" else "as of"
            return " ".join([lead if named.get("lc") == "y" else lead.capitalize(), *reversed(plain)])
        case "time ago":
            when = at(0).strip()
            return f"{when[1:]} ago" if when.startswith("-") else f"{when[1:]}'s time" if when.startswith("+") else f"on {when}" if when else ""
    return re.sub(r"\{\{#(\d+)\}\}", lambda a: at(int(a[1]) - 1), rule)


def resolve_templates(text: str, config: Config, boxes: list[tuple[str, list[tuple[str, str]]]]) -> str:
    """Innermost templates first; infoboxes are put aside and leave a mark on a line of its own."""
    pattern = re.compile(r"\{\{([^{}]*)\}\}")
    while m := pattern.search(text):
        parts = [p.strip() for p in split_arguments(m[1])]
        name = parts[0].lower().removeprefix("template:").strip()
        plain = [p for p in parts[1:] if not re.match(r"[\w\- ]+=", p)]
        named = {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in parts[1:] if p not in plain)}
        if name.startswith("infobox"):
            boxes.append((parts[0], list(named.items())))
            new = f"\n\n\x00BOX{len(boxes) - 1}\x00\n\n"
        else:
            new = expand(config.templates.get(name) or ("first" if name.startswith("lang-") else "drop"), plain, named)
        text = text[: m.start()] + new + text[m.end() :]
    return text


def inline(text: str, own: str, config: Config) -> tuple[str, list[tuple]]:
    """(plain text, links); external links leave their anchor, links to the page itself its id."""
    links: list[tuple] = []

    def link(m: re.Match) -> str:
        target, _, anchor = m[1].partition("|")
        target, _, section = target.partition("#")
        anchor = (anchor or m[1]).strip()
        name = normal_name(target) if target.strip() else own
        links.append((name, section.strip() or None, page_id(name, config), anchor))
        return anchor

    text = re.sub(r"\[\[([^\[\]]*)\]\]", link, text)
    text = re.sub(r"\[(?:https?|ftp)://\S+\s+([^\]]*)\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://\S+\]", "", text)
    return " ".join(html.unescape(text).split()), links


def parse_page(title: str, text: str | None, config: Config) -> tuple[tuple, list[tuple]]:
    name = normal_name(title)
    pid = page_id(name, config)
    text = text or ""
    forward = re.match(r"\s*#\w+[^\[]*\[\[([^\[\]|]+)", text)
    boxes: list[tuple[str, list[tuple[str, str]]]] = []
    body = resolve_templates(clean(text), config, boxes)
    categories = [normal_name(m) for m in re.findall(r"\[\[\s*[Cc]ategory:([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", body)]
    body = re.sub(r"\[\[\s*[Cc]ategory:[^\[\]]*\]\]", "", body)
    kind = "category" if name.lower().startswith(config.category) else "disambiguation" if name.lower().endswith(config.disambiguation_suffix) else "redirect" if forward else "article"
    page = (pid, name, kind, page_id(normal_name(forward[1]), config) if forward else None, categories)
    nodes: list[tuple] = []
    open_: list[tuple[int, int]] = []  # (heading level, node id)

    def add(kind_: str, heading: str | None = None, level: int | None = None, text_: str | None = None, links: list | None = None) -> None:
        ident = hashlib.sha1(text_.encode()).hexdigest() if kind_ in ("para", "list") and text_ else None
        nodes.append((pid, len(nodes), open_[-1][1] if open_ else None, len(open_), kind_, heading, quote(heading, safe="()/,.-_~!*'") if heading else None, level, ident, text_, links or []))

    waiting: list[str] = []

    def flush() -> None:
        if waiting:
            plain, links = inline(" ".join(waiting), name, config)
            waiting.clear()
            if plain:
                add("para", text_=plain, links=links)

    for raw in body.split("\n"):
        line = raw.strip()
        if m := re.fullmatch(r"(={1,6})\s*(.+?)\s*\1", line):
            flush()
            heading, _ = inline(m[2], name, config)
            level = len(m[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            add("section", heading=heading, level=level)
            open_.append((level, len(nodes) - 1))
        elif m := re.fullmatch(r"\x00BOX(\d+)\x00", line):
            flush()
            tag, pairs = boxes[int(m[1])]
            add("infobox", heading=tag, text_="; ".join(f"{k}={inline(v, name, config)[0]}" for k, v in pairs), links=[x for _, v in pairs for x in inline(v, name, config)[1]])
        elif m := re.match(r"([*#:;]+)\s*(.*)", line):
            flush()
            plain, links = inline(m[2], name, config)
            if plain:
                add("list", level=len(m[1]), text_=plain, links=links)
        elif (m := re.fullmatch(r"\[\[([^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*)\]\]", line)) and m[1].lower().startswith(config.images):
            flush()
            parts = split_arguments(m[1])
            caption, links = inline(parts[-1] if len(parts) > 1 else "", name, config)
            add("image", heading=parts[0].strip(), text_=caption, links=links)
        elif not line:
            flush()
        else:
            waiting.append(line)
    flush()
    return page, nodes


def pages(texts: DataFrame, title_col: str, text_col: str, config: Config | None = None) -> DataFrame:
    """One row a page: id, name, type, redirect target, categories."""
    return _parse(texts, title_col, text_col, config or Config(), PAGE, 0)


def nodes(texts: DataFrame, title_col: str, text_col: str, config: Config | None = None) -> DataFrame:
    """The node table of all pages."""
    return _parse(texts, title_col, text_col, config or Config(), NODE, 1)


def _parse(texts: DataFrame, title_col: str, text_col: str, config: Config, schema: str, part: int) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows: list[tuple] = []
            for title, text in zip(frame["title"], frame["text"]):
                page, found = parse_page(title or "", text, config)
                rows += [page] if part == 0 else found
            out = pd.DataFrame(rows, columns=names)
            for c in ("node_id", "parent_id", "depth", "level"):
                if c in out:
                    out[c] = out[c].astype("Int32")
            yield out

    return texts.select(F.col(title_col).cast("string").alias("title"), F.col(text_col).alias("text")).mapInPandas(work, schema)
