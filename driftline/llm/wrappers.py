"""Main text of pages through wrappers: one union-free regular expression per host, inferred by alignment."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm._tables import BROADCAST_BYTES, Scratch, salted_left_join

#: Expressions that one task aligns; a host with more is aligned in rounds.
FAN_IN = 64
#: Different pages of a host on which a text must stand to be template, and so many if an article or main element holds it.
SUPPORT, SUPPORT_MARKED = 2, 8
#: Longest group of nodes that is looked for as a repetition.
LONGEST_GROUP = 12

# Elements of HTML by how they bear on text.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|math|canvas|video|audio"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html head body article main section div nav header footer aside form ul ol dl table figure details dialog fieldset title button".split())
FURNITURE = frozenset("head title nav header footer aside form dialog fieldset button menu".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related recommended comment comments reply replies breadcrumb breadcrumbs pagination pager widget login signup signin search copyright toolbar skip complementary contentinfo".split()
)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host of an address in lower case; '' where there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _label(name: str, attrs: str) -> str:
    """An element with the furniture names that its class, id or role holds: what tells slots of one tag apart."""
    if not attrs:
        return name
    words = {w for found in _NAMES.findall(attrs) for w in re.split(r"[^a-z0-9]+", "".join(found).lower())}
    marks = sorted(words & (FURNITURE_NAMES | MAIN))
    return ".".join([name, *marks])


def tokens(page: str) -> list[tuple[str, str]]:
    """The page's token stream: (label, text). Text slots are labelled by the containers they stand in.

    Inline tags do not divide text. End tags of blocks that may lack them are left out of labels but divide text.
    """
    out: list[tuple[str, str]] = []
    open_, block = [], []

    def flush() -> None:
        if block and (text := " ".join(entities.unescape("".join(block)).split())):
            out.append(("#" + ">".join(open_), text))
        block.clear()

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            block.append(m["text"])
        elif m["name"]:
            name = m["name"].lower()
            if name == "br":
                block.append(" ")
            elif name in INLINE:
                pass
            elif name not in CONTAINERS:
                flush()
                if not m["close"]:
                    out.append((name, ""))
            elif not m["close"]:
                flush()
                label = _label(name, m["attrs"])
                if not m["attrs"].endswith("/"):
                    open_.append(label)
                    out.append((label, ""))
            else:
                flush()
                at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].split(".")[0] == name), None)
                if at is not None:
                    del open_[at:]
                    out.append(("/" + name, ""))
    flush()
    return out


Node = str | tuple  # a token's label, or a tuple of nodes that repeats


def fold(nodes: list[Node]) -> list[Node]:
    """Replaces runs of equal neighbouring groups by one repeated group, shortest groups first."""
    for size in range(1, LONGEST_GROUP + 1):
        out, i = [], 0
        while i < len(nodes):
            group = nodes[i : i + size]
            j = i + size
            while len(group) == size and nodes[j : j + size] == group:
                j += size
            if j > i + size:
                out.append(group[0] if size == 1 and isinstance(group[0], tuple) else tuple(group))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _collapse(nodes: list[tuple[Node, bool]], groups: set[tuple]) -> list[tuple[Node, bool]]:
    """Single occurrences of groups that repeat elsewhere become the repeated group, where no part is optional."""
    for group in sorted(groups, key=len, reverse=True):
        if len(group) > len(nodes):
            continue
        out, i, k = [], 0, len(group)
        while i < len(nodes):
            if nodes[i][0] == group[0] and tuple(n for n, _ in nodes[i : i + k]) == group and not any(o for _, o in nodes[i : i + k]):
                if out and out[-1][0] == group:
                    out.pop()
                out.append((group, False))
                i += k
            elif out and nodes[i][0] == group and out[-1][0] == group:
                out[-1] = (group, out[-1][1] and nodes[i][1])
                i += 1
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _groups(nodes: list[tuple[Node, bool]]) -> set[tuple]:
    return {n for n, _ in nodes if isinstance(n, tuple)}


def align(a: list[tuple[Node, bool]], b: list[tuple[Node, bool]]) -> list[tuple[Node, bool]]:
    """The expression of both: (node, optional). Where they differ, each side's own nodes become optional.

    A node that repeats in one and stands alone in the other repeats; text slots match by where they stand.
    """
    groups = _groups(a) | _groups(b)
    a, b = _collapse(a, groups), _collapse(b, groups)
    out: list[tuple[Node, bool]] = []
    for kind, i, j, k, l in SequenceMatcher(None, [n for n, _ in a], [n for n, _ in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(x[0], x[1] or y[1]) for x, y in zip(a[i:j], b[k:l], strict=True)]
        else:
            out += [(n, True) for n, _ in a[i:j] + b[k:l]]
    return out


def _ends(node: Node, labels: list[str], starts: set[int]) -> set[int]:
    """Where a word of the node can end, for words that begin at `starts`."""
    if not isinstance(node, tuple):
        return {i + 1 for i in starts if i < len(labels) and labels[i] == node}
    ends: set[int] = set()
    while starts:
        for part in node:
            starts = _ends(part, labels, starts)
        starts -= ends
        ends |= starts
    return ends


def accepts(wrapper: list[tuple[Node, bool]], labels: list[str]) -> bool:
    """Whether a page's stream of labels is a word of the expression."""
    at = {0}
    for node, optional in wrapper:
        at = _ends(node, labels, at) | (at if optional else set())
    return len(labels) in at


def _flat(node: Node) -> Iterator[str]:
    if isinstance(node, tuple):
        for n in node:
            yield from _flat(n)
    else:
        yield node


def slots(wrapper: list[tuple[Node, bool]]) -> set[str]:
    """The text slots of an expression."""
    return {x for n, _ in wrapper for x in _flat(n) if x.startswith("#")}


def _is_furniture(slot: str) -> bool:
    """Whether a container is furniture by its tag, or by a name of its class, id or role."""
    for part in slot[1:].split(">"):
        name, *marks = part.split(".")
        if name in FURNITURE or (name not in ("html", "body", *MAIN) and not FURNITURE_NAMES.isdisjoint(marks)):
            return True
    return False


def content_slots(found: set[str]) -> tuple[set[str], bool]:
    """The slots of a page that hold main text, and whether an article or main element tells so.

    They are the slots in such an element, less furniture. Without one: all slots that are no furniture, so what stands
    in the common container of the page's text blocks.
    """
    plain = {s for s in found if not _is_furniture(s)}
    main = {s for s in plain if any(not MAIN.isdisjoint(p.split(".")) for p in s[1:].split(">"))}
    return (main, True) if main else (plain, False)


def _text_id(slot: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{slot}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _dump(wrapper: list[tuple[Node, bool]]) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)


def _tuples(node: object) -> Node:
    return tuple(map(_tuples, node)) if isinstance(node, list) else node  # type: ignore[return-value]


def _load(text: str) -> list[tuple[Node, bool]]:
    return [(_tuples(n), bool(o)) for n, o in json.loads(text)]


def expression(wrapper: list[tuple[Node, bool]]) -> str:
    """A wrapper spelled as a regular expression over tags, with #text for slots."""

    def spell(node: Node) -> str:
        if isinstance(node, tuple):
            return "(" + "".join(map(spell, node)) + ")+"
        return "#text" if node.startswith("#") else f"<{node}>"

    return "".join(spell(n) if not o else f"({spell(n)})?" for n, o in wrapper)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper per host from all of its pages: host, wrapper, template (texts by slot that are no content).

    Each page's stream is folded; equal streams of a host count once, so a host with a third of all pages has few.
    Streams are aligned FAN_IN at a time, in rounds, until each host has one expression. Text slots are aligned by
    where they stand and what they hold: a text that is in a slot on all of the host's different pages that have the slot,
    SUPPORT or more, is template; within an article or main element it takes SUPPORT_MARKED pages.
    """
    scratch = Scratch(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            bare: dict[tuple[str, int], tuple[list[int], list[int], bool]] = {}
            for url, page in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                host, stream = host_of(url), tokens(page or "")
                labels = [label for label, _ in stream]
                seen[host, _dump([(n, False) for n in fold(labels)])] += 1
                keep, marked = content_slots({x for x in labels if x.startswith("#")})
                if keep:
                    blocks = {(label, text) for label, text in stream if label in keep}
                    name = _text_id("", json.dumps(stream))
                    bare[host, name] = [_text_id(*b) for b in sorted(blocks)], [_text_id(label, "") for label, _ in sorted(blocks)], marked
            columns = [
                pa.array([host for host, _ in seen] + [host for host, _ in bare], pa.string()), pa.array([x for _, x in seen] + [None] * len(bare), pa.string()),
                pa.array([None] * len(seen) + [name for _, name in bare], pa.int64()),
                *(pa.array([None] * len(seen) + [lists[k] for lists in bare.values()], pa.list_(pa.int64())) for k in (0, 1)),
                pa.array([None] * len(seen) + [marked for _, _, marked in bare.values()], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "stream", "page", "texts", "slots", "marked"])

    read = pages.select(pages[url_col].alias("_url"), pages[html_col].alias("_html")).mapInArrow(run, "host string, stream string, page long, texts array<long>, slots array<long>, marked boolean")
    # repeated streams and pages leave here; lists are those of equal pages, so any will do
    found = scratch.write("found", read.groupBy("host", "stream", "page").agg(F.first("texts").alias("texts"), F.first("slots").alias("slots"), F.first("marked").alias("marked")))
    bare = found.where("page is not null")
    counted = bare.select("host", "marked", F.explode(F.arrays_zip("texts", "slots")).alias("x")).groupBy("host", F.col("x.texts").alias("text"), F.col("x.slots").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.max("marked").alias("marked"))
    counted = counted.where(F.col("n") >= F.when(F.col("marked"), SUPPORT_MARKED).otherwise(SUPPORT))
    with_slot = bare.select("host", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"))
    # a host's template has no more texts than its shortest pages
    template = counted.join(with_slot, ["host", "slot", "n"]).groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("template"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[Node, bool]] | None = None
        for text in sorted(group["wrapper"]):
            made = _load(text) if made is None else align(made, _load(text))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_dump(made or [])]})

    step, k = found.where("stream is not null").select("host", F.col("stream").alias("wrapper")), 0
    while True:
        sizes = step.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
        salted = salted_left_join(step, sizes, ["host"], F.xxhash64("wrapper")).withColumn("_part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("_n") / FAN_IN)))
        step, k = scratch.write(f"round{k}", salted.select("host", "wrapper", "_part").groupBy("host", "_part").applyInPandas(merge, "host string, wrapper string")), k + 1

    return scratch.write("wrappers", step.join(template, "host", "left").select("host", "wrapper", F.coalesce("template", F.array().cast("array<long>")).alias("template")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page through its host's wrapper: id, url, text, n_chars, matched.

    The page's token stream is matched to the wrapper; texts in the page's content slots (see `content_slots`) are its
    blocks, joined in page order by one space. Character references are decoded and white space in a block becomes one
    space. Blocks that are template go, unless the page has no others.

    Null and empty pages have text ''. Pages without a host share the wrapper of ''. `matched` is false where the
    wrapper does not accept a page. Repeated rows are read alike; an empty table gives an
    empty result; other columns are not read.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)
    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    host = F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), _HOST.pattern, 1))
    size = wrappers.agg(F.sum(F.length("wrapper") * 4 + F.size("template") * 8 + F.length("host") * 4)).first()[0] or 0
    rows = rows.withColumn("host", host)
    joined = rows.join(F.broadcast(wrappers), "host", "left") if size <= BROADCAST_BYTES else salted_left_join(rows, wrappers, ["host"], F.xxhash64("_id", "_url"))
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("matched", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list, set[int], dict]] = {}
        for batch in batches:
            texts, fits = [], []
            for host, page, wrapper, template in zip(*(batch.column(c).to_pylist() for c in ("host", "_html", "wrapper", "template")), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = (_load(wrapper), set(template), {}) if wrapper is not None else ([], set(), {})
                expected, fixed, seen = known[host]
                stream = tokens(page or "")
                labels = tuple(label for label, _ in stream)
                if (found := seen.get(labels)) is None:
                    if len(seen) > 1000:
                        seen.clear()
                    found = seen[labels] = accepts(expected, list(labels)), *content_slots({x for x in labels if x.startswith("#")})
                fit, keep, _ = found
                blocks = [(label, text) for label, text in stream if text and label in keep]
                if fixed:
                    blocks = [b for b in blocks if _text_id(*b) not in fixed] or blocks
                texts.append(" ".join(text for _, text in blocks))
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(fits, pa.bool_())], names=schema.names)

    return joined.select("_id", "_url", "_html", "host", "wrapper", "template").mapInArrow(run, schema)
