"""Web pages as blocks of prose, and what becomes of the blocks: pauses, verdicts, counts and second opinions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words
from ..scratch import materialise

LEAST_WORDS, ADAPTED_WORDS, LEAST_RUN, OPINION_WORDS = 40, 12, 3, 50

#: Elements that hold prose, elements whose insides are none, and hosts with elements of their own.
PROSE = {"p", "li", "blockquote", "dd", "figcaption"}
SKIP = {"nav", "header", "footer", "aside", "code", "pre", "textarea", "input", "select", "button", "label", "svg", "script", "style", "noscript"}
ADAPTERS = [
    (r"(^|\.)(x|twitter)\.com$", '[data-testid="tweetText"]'),
    (r"(^|\.)reddit\.com$", '[slot="comment"], [slot="text-body"], [data-testid="comment"], .usertext-body .md'),
    (r"(^|\.)linkedin\.com$", ".feed-shared-update-v2__description, .update-components-text, .comments-comment-item__main-content"),
    (r"(^|\.)youtube\.com$", "#content-text"),
    (r"(^|\.)ycombinator\.com$", ".commtext"),
    (r"(^|\.)bsky\.app$", '[data-testid="postText"]'),
    (r"(^|\.)threads\.(net|com)$", 'div[data-pressable-container] span[dir="auto"]'),
    (r"(^|\.)facebook\.com$", '[data-ad-preview="message"], [data-ad-comet-preview="message"]'),
]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = PROSE | {"div", "section", "article", "main", "ul", "ol", "dl", "dt", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "form", "header", "footer", "nav", "aside", "pre"}
#: Start tags that end an open paragraph, and items that end their like.
_ENDS_P = _BLOCKS - {"figcaption"} | {"hr", "address", "details", "fieldset", "figcaption", "hgroup", "menu"}
_ENDS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_WORD = re.compile("[A-Za-z0-9][A-Za-z0-9'’-]*")


def host_of(url: Column | str) -> Column:
    """The host of a web address in lower case, else empty."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.when(u.rlike("(?i)^https?://"), F.lower(F.try_parse_url(u, F.lit("HOST")))), F.lit(""))


def adapter_of(host: Column | str) -> Column:
    """The selector that a host has of its own, or null."""
    h = F.col(host) if isinstance(host, str) else host
    return F.coalesce(*[F.when(h.rlike(pattern), F.lit(selector)) for pattern, selector in ADAPTERS])


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "no", "skip")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None", no: int):
        self.tag, self.attrs, self.parent, self.children, self.no = tag, attrs, parent, [], no
        own = tag in SKIP or attrs.get("contenteditable", "no") in ("", "true", None) or attrs.get("role") in ("textbox", "navigation")
        self.skip = own or bool(parent and parent.skip)

    def elements(self) -> Iterator["_Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def content(self) -> str:
        """All text below, as it stands."""
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo += reversed(node.children)
        return "".join(parts)

    def rendered(self) -> str:
        """Text as a reader sees it: white space collapsed, lines broken at <br> and at blocks, hidden parts left out."""
        parts: list[str] = []
        todo: list = [*reversed(self.children)]
        while todo:
            c = todo.pop()
            if c is None:  # where a block ends
                parts.append("\n")
            elif isinstance(c, str):
                parts.append(re.sub(r"[ \t\r\n\f]+", " ", c))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in ("script", "style", "noscript"):
                if c.tag in _BLOCKS:
                    parts.append("\n")
                    todo.append(None)
                todo += reversed(c.children)
        return re.sub(r" *\n[ \n]*", "\n", re.sub(r" {2,}", " ", "".join(parts))).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None, 0)
        self.count, self.open = 0, Counter()

    def _close(self, tags: set[str], within: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent and node.tag not in within:
            if node.tag in tags:
                while self.at is not node.parent:
                    self.open[self.at.tag] -= 1
                    self.at = self.at.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, {"table", "button"})
        if tag in _ENDS_LIKE:
            self._close(_ENDS_LIKE[tag], {"ul", "ol", "dl"})
        self.count += 1
        node = _Node(tag, dict(attrs), self.at, self.count)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


_PART = re.compile(r"([a-z]*)((?:\[[^\]]+\]|\.[\w-]+|#[\w-]+)*)$")


def _matches(node: _Node, selector: str) -> bool:
    """Of the selectors that adapters use: tag, class, id, attributes, descent and lists of these."""

    def simple(n: _Node, part: str) -> bool:
        tag, rest = _PART.match(part).groups()
        if tag and n.tag != tag:
            return False
        for one in re.findall(r"\[[^\]]+\]|\.[\w-]+|#[\w-]+", rest):
            if one[0] == ".":
                ok = one[1:] in (n.attrs.get("class") or "").split()
            elif one[0] == "#":
                ok = n.attrs.get("id") == one[1:]
            else:
                name, _, value = one[1:-1].partition("=")
                ok = name in n.attrs and (not value or n.attrs[name] == value.strip('"'))
            if not ok:
                return False
        return True

    for alternative in selector.split(", "):
        *above, last = alternative.split(" ")
        if simple(node, last):
            up = node.parent
            for part in reversed(above):
                while up is not None and not simple(up, part):
                    up = up.parent
                if up is None:
                    break
                up = up.parent
            else:
                return True
    return False


def blocks_of(html: str | None, selector: str | None) -> list[tuple[int, int, str, str, int]]:
    """(number, parent's number, kind, text, words) of the leaf elements of prose, before short ones are merged."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    chosen = [n for n in tree.root.elements() if n.tag and (n.tag in PROSE or selector and _matches(n, selector))]
    inner = {id(n) for n in chosen}
    holds: set[int] = set()
    for n in chosen:
        up = n.parent
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    found = []
    for n in chosen:
        if n.skip or id(n) in holds & inner:
            continue
        raw = n.content().strip()
        words = len(_WORD.findall(raw))
        adapted = bool(selector) and words >= ADAPTED_WORDS and _matches(n, selector)
        if words >= LEAST_WORDS or adapted:
            found.append((n.no, n.parent.no, "block", n.rendered(), words))
        elif words:
            found.append((n.no, n.parent.no, "short", raw, words))
    return found


#: Pages whose trees a worker builds before it hands their blocks on.
PAGES_AT_ONCE = 64


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(a, PAGES_AT_ONCE) for b in batches for a in range(0, max(1, b.num_rows), PAGES_AT_ONCE)):
        rows = []
        for page, host, html, selector in zip(*[batch.column(c).to_pylist() for c in ("page_id", "host", "html", "selector")], strict=True):
            rows += [(page, host, *b) for b in blocks_of(html, selector)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
        names = ["page_id", "host", "block_no", "parent_no", "kind", "text", "words"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def leaves(pages: DataFrame) -> DataFrame:
    """page_id, host, block_no, parent_no, kind (block or short), text, words of pages (page_id, url, html)."""
    hosts = pages.select("page_id", host_of("url").alias("host"), "html").withColumn("selector", adapter_of("host"))
    return hosts.mapInArrow(_extract, "page_id long, host string, block_no int, parent_no int, kind string, text string, words int")


def merge_short(found: DataFrame) -> DataFrame:
    """Short leaves of one parent, three at least, as one block if they have enough words together."""
    runs = found.where("kind = 'short'").groupBy("page_id", "host", "parent_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("own"))
    text = F.array_join(F.transform("own", lambda x: x["text"]), "\n")
    merged = runs.where(F.size("own") >= LEAST_RUN).select("page_id", "host", F.col("own")[0]["block_no"].alias("block_no"), "parent_no", F.lit("merged").alias("kind"), text.alias("text"))
    return merged.withColumn("words", count_words("text")).where(F.col("words") >= LEAST_WORDS).select(*found.columns)


def html_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of pages: long leaves, and merged runs of short ones."""
    found = leaves(pages)
    return found.where("kind = 'block'").unionByName(merge_short(found))


def dedupe_blocks(blocks: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One unit a leading element (the first by number of words), without those ``scored`` before at the same length."""
    rank = F.row_number().over(Window.partitionBy("page_id", "block_no").orderBy(F.desc("words"), "text"))
    one = blocks.withColumn("__rank", rank).where("__rank = 1").drop("__rank").withColumn("length", F.length("text"))
    return one if scored is None else one.join(scored.select("page_id", "block_no", "length"), ["page_id", "block_no", "length"], "left_anti")


def without_paused(pages: DataFrame, paused: DataFrame) -> DataFrame:
    """Pages (with host) whose host isn't paused. Spark broadcasts ``paused`` (host) if it is small."""
    return pages.join(paused.select("host").distinct(), "host", "left_anti")


def action_state(verdict: Column | str, action: str = "blur") -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.when(v == "slop", "blocked" if action == "blur" else "labelled").when(v == "suspect", "labelled")


def badge(n: Column) -> Column:
    return F.when(n == 0, "").when(n > 999, "999+").otherwise(n.cast("string"))


def page_counts(units: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """page_id, n (units with verdict slop) and badge. units: page_id, verdict, and host if ``paused`` hosts are given."""
    keys = ["page_id"] if paused is None else ["page_id", "host"]
    counts = units.groupBy(*keys).agg(F.count_if(F.col("verdict") == "slop").alias("n"))
    off = F.lit(False)
    if paused is not None:
        counts = counts.join(paused.select("host", F.lit(True).alias("__off")).distinct(), "host", "left")
        off = F.coalesce("__off", F.lit(False))
    return counts.select(*keys, "n", F.when(off, "off").otherwise(badge(F.col("n"))).alias("badge"))


def text_hash(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


#: Hashes of texts up to which they are broadcast: 64 characters each.
MOST_BROADCAST = 200_000


def _few(hashes: DataFrame) -> DataFrame:
    """A table of hashes, written once; broadcast if it is counted and small, else Spark joins by shuffle."""
    kept = materialise(hashes, "hashes")
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def to_ask(blocks: DataFrame, opinions: DataFrame) -> DataFrame:
    """text_hash, text: each text that has no opinion yet, once.

    Hashes alone are shuffled to find which texts these are. The texts that have an opinion stay where they are; of the others
    each task sends one copy.
    """
    hashed = blocks.select(text_hash("text").alias("text_hash"), "text")
    known = _few(hashed.select("text_hash").distinct().join(opinions.select("text_hash"), "text_hash", "left_semi"))
    return hashed.join(known, "text_hash", "left_anti").groupBy("text_hash").agg(F.first("text").alias("text"))


def apply_opinions(blocks: DataFrame, opinions: DataFrame, action: str = "blur") -> DataFrame:
    """blocks (text, verdict, words) with state; slop of 50 words that an opinion calls human becomes suspect, and labelled.

    Of a text with several opinions one that says so is enough. Hashes of texts that can change are joined with the opinions;
    only those that do change, mostly few, come back to the blocks, whose texts aren't shuffled.
    """
    may_change = (F.col("verdict") == "slop") & (F.col("words") >= OPINION_WORDS)
    human = opinions.where(F.col("label").rlike("(?i)human")).select("text_hash")
    spared = _few(blocks.where(may_change).select(text_hash("text").alias("text_hash")).distinct().join(human, "text_hash", "left_semi"))
    marked = blocks.withColumn("__hash", F.when(may_change, text_hash("text"))).join(spared.select(F.col("text_hash").alias("__hash"), F.lit(True).alias("__spared")), "__hash", "left")
    spare = F.coalesce("__spared", F.lit(False))
    return marked.select(*blocks.columns, F.when(spare, "suspect").otherwise(F.col("verdict")).alias("final"), F.when(spare, "labelled").otherwise(action_state("verdict", action)).alias("state"))


def map_opinions(answers: DataFrame) -> DataFrame:
    """text_hash, label, headline, ai, assisted, human, error from raw answers; what is missing is empty or 0."""
    failed = F.col("stage") == "STAGE_FAILED"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    error = F.when(failed, F.coalesce(F.when(F.col("headline") != "", F.col("headline")), F.when(F.col("detail") != "", F.col("detail")), F.lit("task failed")))
    return answers.select("text_hash", text("prediction_short").alias("label"), text("headline").alias("headline"), number("fraction_ai").alias("ai"), number("fraction_ai_assisted").alias("assisted"), number("fraction_human").alias("human"), error.alias("error"))


#: Settings as they are if nothing is stored.
DEFAULTS = {"eat": "true", "sensitivity": "balanced", "action": "blur", "images": "true", "cook": "true", "opinion": "off"}


def merge_settings(stored: Column | str) -> Column:
    """A map of all settings: those stored, and defaults for keys that are missing."""
    have = F.coalesce(F.col(stored) if isinstance(stored, str) else stored, F.create_map().cast("map<string,string>"))
    missing = F.map_filter(F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair]), lambda k, _: ~F.map_contains_key(have, k))
    return F.map_concat(missing, have)
