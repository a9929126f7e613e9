"""Main text of pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts.  Immediate repeats of a run of tokens become a
repeated group, which leaves a short skeleton.  The distinct skeletons of a host are aligned one
after the other: equal tokens stay, a run that only one side has becomes an optional group, a
group that the other side has once is a repeated group there too.  The result is the host's
wrapper, a regular expression of tags, slots, ``(...)+`` and ``(...)?`` without alternatives.

Every node keeps the texts that all pages aligned at it have in common.  What is equal in all of
them, on pages of at least TEMPLATE different texts, is template; the rest is a slot.

Names and classes say which regions a page has: its text is that of its article or main region,
or without text in one, all of the body, but never text inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments, which are told by tag, role, class
or id.  Of the body, and of parts of a region whose names only hint at a menu or notice, the
wrapper's template goes too; other text of an article or main stays, equal or not.  A block goes
as a whole or not at all, so that a label inside a sentence stays.

Skeletons are made distinct in every task before the shuffle and aligned in a tree: every round
deals a host's expressions into parts of about FAN and leaves one of each part, until the host has
one wrapper.  So neither a hot host nor one with many layouts meets in one task.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table
from standlab.llm.url_filter import host_of
from standlab.session import cut_lineage

PERIOD = 12  # tokens of a repeated run at most
FAN = 16  # expressions of a host that are aligned in one part of a round
HELD = 5000  # distinct skeletons that a task holds before it passes them on
TEMPLATE = 3  # pages of different text that show a common text to be template; two may be copies
SLOT = "#"

# fixed values: names of HTML elements and of page regions
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe select".split())
INLINE = set("a abbr b bdi bdo big br button cite code del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms "
             "msqrt msub msubsup msup mtext object q s samp small span strike strong sub sup svg time tt u var wbr".split())
SKIPPED = set("nav header footer aside form head dialog menu".split()) | RAW
REGION = set("article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
             "pre section table ul".split())
SCOPE = set("ul ol dl table article body div section".split())
_NAMES = ("ads?|adverts?|advertisements?|advertising|banners?|sponsored|sponsors?|promos?|promotions?|nav|navbar|"
          "navigation|menus?|breadcrumbs?|sidebars?|widgets?|footers?|headers?|masthead|cookies?|notices?|consent|gdpr|alerts?|popups?|"
          "modals?|overlay|newsletters?|subscribe|subscription|signup|login|search|share|sharing|social|comments?|commentlist|"
          "replies|reply|discussion|disqus|respond|related|recommended|toolbar|pagination|pager|skip")
_SITE = "site|page|main|global|top|bottom|left|right|primary|secondary|sub|sticky|mobile|desktop"
_PARTS = ("area|bar|block|box|buttons?|container|content|form|icons?|inner|items?|links?|list|outer|posts?|row|section|slot|thread|"
          "unit|wrap|wrapper|to|[0-9]+")
_BESIDE = "(?:posts?|article|entry)[_-]+(?=comments?|nav|share|sharing|social|related)"  # a text's header is its own
# a whole class, id or role: names, and besides them only words for a place in the site or for a container
NOISE = re.compile(rf"(?:(?:{_SITE})[_-]+|{_BESIDE})*(?:{_NAMES})(?:[_-]+(?:{_NAMES}|{_SITE}|{_PARTS}))*", re.I)
HINT = re.compile(rf"(?:^|[_-])(?:{_NAMES})(?=$|[_-])", re.I)  # a name inside another one
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PLAIN = re.compile(r"[A-Za-z_-]*[A-Za-z_]")  # classes with digits may be those of one page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LAYOUT = re.compile(r"\b(?:no|has|with|without)[-_][\w-]+", re.I)  # names of the page's layout, not of a region
_ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog)$", re.I)


def tokens(source: str | None):
    """('open', name, label), ('close', name, None) and ('text', raw, None) of a page, in order.

    The inside of raw elements is skipped; a tag that the page ends in is none.
    """
    source = source or ""
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            rest = source[at:]
            cut = re.search(r"<(?=[a-zA-Z/!])", rest)
            yield "text", rest[:cut.start()] if cut else rest, None
            return
        if m.start() > at:
            yield "text", source[at:m.start()], None
        at = m.end()
        if m[2] is None:
            continue
        if not m[0].endswith(">"):
            return
        name = m[2].lower()
        if m[1]:
            yield "close", name, None
            continue
        yield "open", name, _label(name, m[3] or "")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            yield "close", name, None


def _label(name: str, attributes: str) -> str:
    """Name and classes of an element; '-' behind them where it is no main text, '~' for a hint of that.

    It is no main text by its name, or by a whole class, id or role.  An article or main is never
    told by these, and a name that is part of another one, as in entry-header or
    share-price-report, is a hint.
    """
    if name in SKIPPED:
        return name + "-"
    if name in ("html", "body", *REGION) or "=" not in attributes:
        return name
    mark = ""
    for m in _MARKS.finditer(attributes):
        for t in (m[1] or m[2] or m[3] or "").split():
            if _LAYOUT.fullmatch(t):
                continue
            if NOISE.fullmatch(t) or _ROLES.match(t):
                return name + "-"
            if HINT.search(t):
                mark = "~"
    m = _CLASS.search(attributes)
    classes = sorted({t for t in (m[1] or m[2] or m[3] or "").split() if _PLAIN.fullmatch(t)}) if m else []
    return ".".join([name, *classes]) + mark


def place(path: str) -> str:
    """'noise', 'region' (inside an article or main), 'hint' (there, where a name hints at noise) or 'body'."""
    elements = path.split("/")
    if any(e.endswith("-") for e in elements):
        return "noise"
    if not REGION & set(elements):
        return "body"
    return "hint" if any(e.endswith("~") for e in elements) else "region"


def texts(source: str | None):
    """(path, raw text, block number) of all text of a page; a path has the labels of the open elements.

    Open paragraphs, items and cells end
    as in HTML; a block ends wherever an element that is not inline begins or ends.
    """
    names: list[str] = []
    labels: list[str] = []
    block = 0
    for kind, value, label in tokens(source):
        if kind == "text":
            yield "/".join(labels), value, block
            continue
        if value not in INLINE:
            block += 1
        if kind == "open":
            if value in ENDS_P and "p" in names:
                del labels[names.index("p"):], names[names.index("p"):]
            elif value in CLOSED_BY:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] in CLOSED_BY[value]:
                        del names[i:], labels[i:]
                        break
                    if names[i] in SCOPE:
                        break
            if value not in VOID:
                names.append(value)
                labels.append(label)
        elif value in names:
            i = len(names) - 1 - names[::-1].index(value)
            del names[i:], labels[i:]


def mark(path: str, raw: str) -> int:
    """48 bits of a path and its text without regard to white space."""
    data = f"{path}\n{' '.join(html.unescape(raw).split())}".encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(data, digest_size=6).digest(), "big")


def candidates(source: str | None) -> list[tuple[str, str, int]]:
    """(path, raw text, block) of a page that can be main text: its region's, or without text there its body's."""
    found, where = list(texts(source)), {}
    for path, _, _ in found:
        if path not in where:
            where[path] = place(path)
    clean = [t for t in found if where[t[0]] != "noise"]
    inside = [t for t in clean if where[t[0]] != "body"]
    return inside if any(raw.strip() for _, raw, _ in inside) else clean


NONE = (frozenset(), ())  # of a slot: no common texts, seen on no pages


def skeleton(source: str | None) -> tuple[list, list]:
    """Paths of the page's slots in order, with immediate repeats as groups ('+', [...]), and for
    each node (marks of its texts, marks of the pages).  Noise, which is never taken, is left out."""
    page = hashlib.blake2b(digest_size=6)
    for path, raw, _ in candidates(source):
        page.update(mark(path, raw).to_bytes(6, "big"))
    seen = (int.from_bytes(page.digest(), "big"),)
    out: list = []
    known: list = []
    for path, raw, _ in texts(source):
        where = place(path)
        if where == "noise" or not raw.strip():
            continue
        out.append(path + SLOT)
        known.append(set() if where == "region" else {mark(path, raw)})
        _fold(out, known)
    return out, [(frozenset(k), seen) if k else NONE for k in known]


def _fold(out: list, known: list) -> None:
    """Take back the last run if it repeats the run, or the group, before it."""
    for k in range(1, min(PERIOD, len(out) - 1) + 1):
        group = out[-k - 1]
        if isinstance(group, tuple) and group[0] == "+" and list(group[1]) == out[-k:]:
            known[-k - 1].update(*known[-k:])
            del out[-k:], known[-k:]
            return
        if 2 * k <= len(out) and out[-k:] == out[-2 * k:-k]:
            run = tuple(out[-k:])
            texts_of = set().union(*known[-2 * k:])
            del out[-2 * k:], known[-2 * k:]
            out.append(run[0] if k == 1 and isinstance(run[0], tuple) and run[0][0] == "+" else ("+", run))
            known.append(texts_of)
            return


def align(a: list, b: list) -> list:
    """The union-free expression of two: common nodes stay, what one lacks is optional."""
    return merge(a, [NONE] * len(a), b, [NONE] * len(b))[0]


def merge(a: list, known_a: list, b: list, known_b: list) -> tuple[list, list]:
    """``align`` of two expressions, and what is known of the texts at its nodes."""
    if a == b:
        return a, [_common(p, q) for p, q in zip(known_a, known_b)]
    plain = [n for n in (*a, *b) if isinstance(n, tuple) and n[0] == "+"]
    (a, known_a), (b, known_b) = _as_groups(a, known_a, plain), _as_groups(b, known_b, plain)
    bare_a, bare_b = ([n[1] if isinstance(n, tuple) and n[0] == "?" else (n,) for n in x] for x in (a, b))
    out, known = [], []
    for op, i, j, k, m in SequenceMatcher(None, bare_a, bare_b, autojunk=False).get_opcodes():
        if op == "equal":  # optional where either side has it optional
            out += [x if isinstance(x, tuple) and x[0] == "?" else y for x, y in zip(a[i:j], b[k:m])]
            known += [_common(p, q) for p, q in zip(known_a[i:j], known_b[k:m])]
        else:
            for side in (a[i:j], b[k:m]):
                out += [n if isinstance(n, tuple) and n[0] == "?" else ("?", (n,)) for n in side]
            known += [*known_a[i:j], *known_b[k:m]]
    return out, known


def _common(p: tuple, q: tuple) -> tuple:
    """The texts that both sides of a node have; the pages are as many as show a template."""
    both = p[0] & q[0]
    return (both, tuple(sorted({*p[1], *q[1]})[:TEMPLATE])) if both else NONE


def _as_groups(nodes: list, known: list, groups: list) -> tuple[list, list]:
    """Runs that are a known repeated group's content once, as that group."""
    for group in groups:
        run, out, kept, i = list(group[1]), [], [], 0
        while i < len(nodes):
            k = len(run) if nodes[i:i + len(run)] == run else 1
            out.append(group if nodes[i:i + len(run)] == run else nodes[i])
            told = [x for x in known[i:i + k] if x[0]]
            kept.append((frozenset().union(*[t for t, _ in told]), min((p for _, p in told), key=len)) if told else NONE)
            i += k
        nodes, known = out, kept
    return nodes, known


def expression(nodes) -> str:
    """A wrapper as readable text."""
    return " ".join(n if isinstance(n, str) else f"({expression(n[1])}){n[0]}" for n in nodes)


def slots(nodes) -> list[str]:
    found: dict[str, None] = {}
    for n in nodes:
        for path in [n] if isinstance(n, str) else slots(n[1]):
            found.setdefault(path)
    return list(found)


def _tuples(nodes):
    return [n if isinstance(n, str) else (n[0], tuple(_tuples(n[1]))) for n in nodes]


def _written(nodes: list, known: list) -> tuple[str, str]:
    return (json.dumps(nodes, separators=(",", ":")),
            json.dumps([[sorted(t), p] if t else [] for t, p in known], separators=(",", ":")))


def _read(nodes: str, known: str) -> tuple[list, list]:
    return _tuples(json.loads(nodes)), [(frozenset(k[0]), tuple(k[1])) if k else NONE for k in json.loads(known)]


def _template(known: str) -> list[int]:
    return sorted({t for k in json.loads(known) if k and len(k[1]) >= TEMPLATE for t in k[0]})


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of nodes) and template (marks of its constant texts) from pages (host, html) of the same host."""
    columns = ["host", "wrapper", "known"]
    kind = "host string, wrapper string, known string"

    def read(batches):
        found: dict[tuple, list] = {}

        def passed():
            rows = [(h, w, _written([], k)[1]) for (h, w), k in sorted(found.items())]
            found.clear()
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            for h, x in zip(batch["host"], batch["html"]):
                nodes, known = skeleton(x)
                key = h, json.dumps(nodes, separators=(",", ":"))
                found[key] = [_common(p, q) for p, q in zip(found[key], known)] if key in found else known
                if len(found) >= HELD:
                    yield passed()
        yield passed()

    def join(batches):  # rows of a part lie together, the shortest first, equal expressions side by side
        part, last, wrapper, same = None, None, None, None

        def aligned():
            return same if wrapper is None else merge(*wrapper, *same)

        for batch in batches:
            done = []
            for h, k, w, known in zip(batch["host"], batch["part"], batch["wrapper"], batch["known"]):
                row = _read(w, known)
                if (h, k) != part:
                    if part is not None:
                        done.append((part[0], *_written(*aligned())))
                    part, wrapper, same = (h, k), None, row
                elif w == last:
                    same = merge(*same, *row)
                else:
                    wrapper, same = aligned(), row
                last = w
            yield pd.DataFrame(done, columns=columns)
        if part is not None:
            yield pd.DataFrame([(part[0], *_written(*aligned()))], columns=columns)

    def constant(batches):
        for batch in batches:
            yield batch[["host", "wrapper"]].assign(template=[_template(k) for k in batch["known"]])

    state, turn, most = cut_lineage(pages.select("host", "html").mapInPandas(read, kind)), 0, 2
    while most > 1:
        parts = (state.select("host", F.xxhash64("wrapper").alias("w")).distinct().groupBy("host")
                 .agg(F.ceil(F.count(F.lit(1)) / FAN).alias("parts")))
        most = parts.agg(F.max("parts")).first()[0] or 0
        part = F.pmod(F.xxhash64("wrapper", F.lit(turn)), F.col("parts")).alias("part")
        state = cut_lineage(state.join(parts, "host").select("host", part, "wrapper", "known").repartition("host", "part")
                            .sortWithinPartitions("host", "part", F.length("wrapper"), "wrapper", "known")
                            .mapInPandas(join, kind))
        turn += 1
    return state.mapInPandas(constant, "host string, wrapper string, template array<long>")


def main_text(source: str | None, template: set[int]) -> str:
    """Text of a page: references decoded, white space of a block one space, blocks by \\n.

    Blocks of nothing but template are left out, except in a region where no name hints at noise.
    """
    blocks: dict[int, list[str]] = {}
    own: set[int] = set()
    for path, raw, block in candidates(source):
        blocks.setdefault(block, []).append(raw)
        if raw.strip() and (place(path) == "region" or mark(path, raw) not in template):
            own.add(block)
    lines = (" ".join(html.unescape("".join(parts)).split()) for block, parts in blocks.items() if block in own)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and host of every row of ``pages`` (page_id, url, html).

    A null html is empty and has empty text.  Pages without a host (null url, or no ``://``) are one
    host.  Rows may repeat or lack an id; other columns are not used.  n_chars counts code points.
    """
    known = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = cut_lineage(infer(known))

    @F.pandas_udf("string")
    def text_of(sources: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, set(t)) for x, t in zip(sources, templates)], dtype=object)

    found = known.join(wrappers.select("host", "template"), "host").withColumn("text", text_of("html", "template"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host")


@register("op6_main_text")
def op6_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
