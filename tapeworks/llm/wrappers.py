"""Main text of HTML pages, by wrapper induction over the pages of a host.

Each page becomes a DOM tree. Over all distinct pages of a host, and of a host and layout (the tree
of tags, equal neighbours once), each text node is counted by tag path and text; constant are those
on more than half of the other pages. The pages that hold the constants are the wrappers: a page is
aligned with them by simple tree matching, and a node that meets a constant at its place is template;
the other text nodes are slots. Slots are content unless they lie in what is never an article: menus,
page headers, footers, sidebars, notices, adverts, forms, comments and the like, known by element,
role or class. Where a page has an article (else main) element, only slots inside are content. There
the pages that vote are the distinct articles, so that copies under two addresses keep it; a constant
must be in three, and an article of which most would go is a near copy of others and stays whole.

A block is a run of text between block-level tags; br is white space. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line end.
Null and empty pages give "". A page without host is aligned with no other. Every page row gives one
row; repeats give equal texts; further columns stay, columns named text and n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Start tags that end an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPES = frozenset("ul ol dl table article main section div body html aside nav footer header form td th blockquote".split())

OUT_TAGS = frozenset("nav aside footer form script style noscript template head title iframe svg button select textarea object canvas dialog menu input".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that name parts beside an article.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond related recommended "
    "share sharing social widget toolbar pagination pager login search form".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])(?:[^>]*>|[^>]*\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "out", "root", "parts")

    def __init__(self, tag: str, out: bool = False, root: str = "") -> None:
        self.tag, self.out, self.root = tag, out, root
        self.parts: list[Node | str] = []  # text in document order among children


def _kind(tag: str, attrs: str, inside: str) -> tuple[bool, str]:
    """Whether an element is never content, and whether it is an article or main."""
    out = tag in OUT_TAGS or (tag == "header" and not inside)
    if attrs and not out:
        for name, value in _ATTR.findall(attrs):
            words = _WORDS.findall(value.lower())
            if name.lower() == "role":
                out = out or bool(OUT_ROLES.intersection(words))
            else:
                out = out or bool(OUT_WORDS.intersection(words)) or (not inside and "header" in words)
    return out, tag if tag in ("article", "main") and not out else ""


def parse(text: str) -> Node:
    root = Node("#")
    stack = [root]
    roots: list[str] = [""]
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:], roots[k:]
                    break
                if stack[k].tag in SCOPES and tag in INLINE:
                    break
            continue
        attrs = m.group(3)
        if tag not in INLINE and stack[-1].tag != "#":  # a block ends an open paragraph
            ends = CLOSES.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:], roots[k:]
                    if tag not in CLOSES:
                        break
                elif stack[k].tag in SCOPES and stack[k].tag not in ("td", "th"):
                    break
        out, mark = _kind(tag, attrs, roots[-1])
        node = Node(tag, out, mark)
        stack[-1].parts.append(node)
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = n if end is None else end.end()
            continue
        stack.append(node)
        roots.append(roots[-1] or mark)
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def blocks(node: Node, keep=lambda child: not child.out) -> list[tuple[str, Node]]:
    """Texts of the blocks below a node in page order, with the block element of each."""
    found: list[tuple[str, Node]] = []
    run: list[str] = []

    def flush(owner: Node) -> None:
        if run:
            text = _clean(run)
            run.clear()
            if text:
                found.append((text, owner))

    todo: list[tuple] = [("in", node, node)]
    while todo:  # no recursion: pages may nest deeply
        step, x, owner = todo.pop()
        if step == "text":
            run.append(x)
        elif step == "flush":
            flush(owner)
        else:
            inline = x.tag in INLINE
            if x.tag == "br":
                run.append(" ")
                continue
            if not inline:
                flush(owner)
            mine = owner if inline else x
            if not inline:
                todo.append(("flush", None, x))
            for part in reversed(x.parts):
                if isinstance(part, str):
                    todo.append(("text", part, mine))
                elif keep(part):
                    todo.append(("in", part, mine))
                elif part.tag not in INLINE:
                    todo.append(("flush", None, mine))
    flush(node)
    return found


def _roots(node: Node, mark: str) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        for part in reversed(x.parts):
            if isinstance(part, Node) and not part.out:
                if part.root == mark:
                    out.append(part)
                todo.append(part)
    order = {id(x): k for k, x in enumerate(_preorder(node))}
    out.sort(key=lambda x: order[id(x)])
    inner = {id(y) for x in out for y in _preorder(x) if y is not x}
    return [x for x in out if id(x) not in inner]


def _preorder(node: Node):
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))


def _digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def skeleton(root: Node, without: frozenset = frozenset()) -> tuple[list, dict[int, int], list[int]]:
    """The tree to align: [tag, key of own block texts or 0, children]; a key is of tag path and
    texts, elements that are never content are leaves, those in ``without`` are left out. Also each
    block element's key, and the keys in preorder."""
    texts: dict[int, list[str]] = {}
    for text, owner in blocks(root, keep=lambda c: not c.out and id(c) not in without):
        texts.setdefault(id(owner), []).append(text)
    keys: dict[int, int] = {}
    listed: list[int] = []
    top: list = []
    todo = [(root, top, 0)]
    while todo:
        x, into, path = todo.pop()
        if x.tag in INLINE:
            todo.extend((p, into, path) for p in reversed(x.parts) if isinstance(p, Node) and id(p) not in without)
            continue
        path = _digest(path, x.tag)
        key = _digest(path, *texts[id(x)]) if id(x) in texts else 0
        if key:
            keys[id(x)] = key
            listed.append(key)
        own = [x.tag, key, []]
        into.append(own)
        if not x.out:
            todo.extend((p, own[2], path) for p in reversed(x.parts) if isinstance(p, Node) and id(p) not in without)
    return top[0], keys, listed


def flat(tree: list) -> str:
    """A skeleton as lines of tag, key and number of children, in preorder: pages may nest deeply."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out.append(f"{x[0]} {x[1]} {len(x[2])}")
        todo.extend(reversed(x[2]))
    return "\n".join(out)


def unflat(text: str) -> list:
    top: list = []
    open_: list[tuple[list, int]] = [(top, 1)]
    for line in text.split("\n"):
        tag, key, n = line.rsplit(" ", 2)
        into, left = open_.pop()
        node = [tag, int(key), []]
        into.append(node)
        if left > 1:
            open_.append((into, left - 1))
        if int(n):
            open_.append((node[2], int(n)))
    return top[0]


def layout(tree: list) -> int:
    """A digest of a skeleton's tags, equal neighbours taken once."""
    done: dict[int, int] = {}
    todo = [(tree, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo.extend((y, False) for y in x[2])
            continue
        below = [done[id(y)] for y in x[2]]
        done[id(x)] = _digest(x[0], *(k for i, k in enumerate(below) if not i or below[i - 1] != k))
    return done[id(tree)]


def content(root: Node) -> list[Node]:
    """The articles of a page, else its main elements."""
    return _roots(root, "article") or _roots(root, "main")


def groups(host_of: str, found: list[Node], outside: list) -> tuple[int, int]:
    """The groups a page votes in with its articles (else outside of them): host, host and layout."""
    side = "article" if found else "page"
    return _digest(side, host_of), _digest(side, host_of, layout(outside))


def pruned(tree: list, keys: frozenset | set) -> list | None:
    """The skeleton's branches that end in one of the keys; other texts become 0."""
    done: dict[int, list | None] = {}
    todo = [(tree, False)]
    while todo:
        x, ready = todo.pop()
        if not ready:
            todo.append((x, True))
            todo.extend((y, False) for y in x[2])
            continue
        below = [y for y in (done.pop(id(y)) for y in x[2]) if y]
        done[id(x)] = [x[0], x[1] if x[1] in keys else 0, below] if below or x[1] in keys else None
    return done[id(tree)]


def match(a: list, b: list) -> set[int]:
    """Simple tree matching of two skeletons: places (preorder) in ``a`` whose text is constant."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def size(x: list) -> int:
        total, todo = 0, [x]
        while todo:
            y = todo.pop()
            total += 1
            todo.extend(y[2])
        return total

    def pairs(x: list, y: list) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(x[2])) for j in range(len(y[2])) if x[2][i][0] == y[2][j][0]]

    def solve(x: list, y: list) -> None:  # children first, without recursion
        todo = [(x, y, False)]
        while todo:
            p, q, ready = todo.pop()
            key = (id(p), id(q))
            if key in memo:
                continue
            if not ready:
                todo.append((p, q, True))
                todo.extend((p[2][i], q[2][j], False) for i, j in pairs(p, q) if (id(p[2][i]), id(q[2][j])) not in memo)
                continue
            n, m = len(p[2]), len(q[2])
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n):
                row, above = best[i + 1], best[i]
                for j in range(m):
                    both = memo.get((id(p[2][i]), id(q[2][j])))
                    v = above[j] + both[0] if both and p[2][i][0] == q[2][j][0] else 0
                    row[j + 1] = max(v, above[j + 1], row[j])
            chosen, i, j = [], n, m
            while i and j:
                both = memo.get((id(p[2][i - 1]), id(q[2][j - 1])))
                if both and p[2][i - 1][0] == q[2][j - 1][0] and best[i][j] == best[i - 1][j - 1] + both[0]:
                    chosen.append((i - 1, j - 1))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            # a node counts, and more when its text is the same
            memo[key] = (best[n][m] + 1 + (p[1] == q[1] != 0), chosen)

    if a[0] != b[0]:
        return set()
    solve(a, b)
    constant: set[int] = set()
    place: dict[int, int] = {}
    todo = [a]
    while todo:
        x = todo.pop()
        place[id(x)] = len(place)
        todo.extend(reversed(x[2]))
    walk = [(a, b)]
    while walk:
        x, y = walk.pop()
        if x[1] and x[1] == y[1]:
            constant.add(place[id(x)])
        walk.extend((x[2][i], y[2][j]) for i, j in memo[(id(x), id(y))][1])
    return constant


def extract(text: str | None, wrappers: list[tuple[frozenset, list[list]]]) -> str:
    """``wrappers``: sets of constant keys, each with skeletons of pages that hold them."""
    root = parse(text or "")
    found = content(root)
    part = root
    if found:
        part = Node("#")
        part.parts = list(found)
    if not wrappers:  # nothing is constant here
        return "\n".join(t for t, _ in blocks(part))
    tree, keys, _ = skeleton(part)
    constant: set[int] = set()
    for common, trees in wrappers:
        own = pruned(tree, common)
        if own is None:
            continue
        order, todo = [], [own]
        while todo:
            x = todo.pop()
            order.append(x[1])
            todo.extend(reversed(x[2]))
        for other in trees:
            constant.update(order[k] for k in match(own, other))
    every = blocks(part)
    kept = [t for t, owner in every if keys.get(id(owner)) not in constant]
    if found and 2 * sum(map(len, kept)) < sum(len(t) for t, _ in every):
        kept = [t for t, _ in every]  # a near copy of other articles, not a template around this one
    return "\n".join(kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _facts(batches):
    """The votes of pages (host, html): per group its voter (equal ones count once), keys and skeleton."""
    names = ["groups", "voter", "keys", "tree", "least"]
    for batch in batches:
        rows: list[tuple] = []
        for of, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(h or "")
            found = content(root)
            tree, _, keys = skeleton(root, frozenset(map(id, found)))
            rows.append(([_digest("page", of), _digest("page", of, layout(tree))], _digest(*keys, h if not keys else ""), sorted(set(keys)), flat(tree), [2, 3]))
            if found:
                inner = Node("#")
                inner.parts = list(found)
                both = list(groups(of, found, tree))
                tree, _, keys = skeleton(inner)
                rows.append((both, _digest(*keys), sorted(set(keys)), flat(tree), [3, 3]))
        types = [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def wrappers(pages: DataFrame) -> DataFrame:
    """Of pages (host, html) each group's constants: keys that are on more than half of a page's
    fellows, and for each key the richest page that holds it (group, constants, trees)."""
    voted = _tables.stored(pages.mapInArrow(_tables.lean(_facts), "groups array<long>, voter long, keys array<long>, tree string, least array<int>"), "wrapper-votes")
    _tables.release_memory(pages.sparkSession)
    facts = voted.select(F.explode(F.arrays_zip("groups", "least")).alias("g"), "voter", "keys", "tree").select(F.col("g.groups").alias("grp"), F.col("g.least").alias("least"), "voter", "keys", "tree")
    votes = facts.groupBy("grp", "voter").agg(F.max("least").alias("least"), F.max("keys").alias("keys"))
    size = votes.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    held = votes.select("grp", "least", F.struct(F.size("keys").alias("n"), "voter").alias("by"), F.explode("keys").alias("key"))
    counted = held.groupBy("grp", "key").agg(F.count("*").alias("n"), F.max("least").alias("least"), F.max("by").alias("by")).where("n >= least AND n > 1")
    chosen = counted.join(size, "grp").where("2 * (n - 1) > size - 1").select("grp", "key", F.col("by.voter").alias("voter")).persist(StorageLevel.DISK_ONLY)
    chosen.count()  # so that heaps are given back between the sorts and the files
    _tables.release_memory(pages.sparkSession)
    common = _tables.stored(chosen, "wrapper-keys")
    chosen.unpersist()
    best = facts.join(common.select("grp", "voter").distinct(), ["grp", "voter"]).groupBy("grp", "voter").agg(F.min("tree").alias("tree"))
    trees = best.groupBy("grp").agg(F.sort_array(F.collect_list("tree")).alias("trees"))
    out = _tables.stored(common.groupBy("grp").agg(F.sort_array(F.collect_list("key")).alias("constants")).join(trees, "grp"), "wrappers")
    _tables.discard(voted, common)
    return out


@_tables.shielded()
def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """All columns, with ``text`` and ``n_chars``. Executors give their heaps back before files
    are written: where Hadoop starts a child process for each new file (chmod on local disks), the
    child shares the JVM's memory for a moment, and all of it may be counted twice."""
    _tables.release_memory(pages.sparkSession)
    named = pages.withColumn("__host", host(F.col(url)))
    found = wrappers(named.where((F.col("__host") != "") & F.col(html).isNotNull()).select("__host", F.col(html).alias("h")))
    _tables.release_memory(pages.sparkSession)

    def place():
        def kernel(part: pa.RecordBatch) -> dict:
            column = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()
            out: list[tuple] = []
            for h, of in zip(column(html), column("__host")):
                root = parse(h or "") if of else None
                roots = content(root) if of else []
                out.append(groups(of, roots, skeleton(root, frozenset(map(id, roots)))[0]) if of else (None, None))
            return {"__all": pa.array([x[0] for x in out], pa.int64()), "__layout": pa.array([x[1] for x in out], pa.int64())}

        return kernel

    joined = _tables.scan_texts(named, html, [T.StructField("__all", T.LongType()), T.StructField("__layout", T.LongType())], place, also=("__host",))
    sides = ("__all", "__layout")
    for c in sides:  # stored, so a host with most of the pages can be split in the join
        joined = joined.join(found.select(F.col("grp").alias(c), F.struct("constants", "trees").alias(f"{c}_w")), c, "left")

    def make():
        known: dict[tuple, tuple] = {}

        def kernel(part: pa.RecordBatch) -> dict:
            column = lambda name: part.column(part.schema.get_field_index(name))
            marks = [column(c).to_pylist() for c in sides]
            raw = [column(f"{c}_w") for c in sides]
            out = []
            for k, h in enumerate(column(html).to_pylist()):
                mine = []
                for mark, side in zip(marks, raw):
                    if mark[k] is None or not side[k].is_valid:
                        continue
                    if mark[k] not in known:
                        if len(known) > 256:
                            known.clear()
                        w = side[k].as_py()
                        keys = frozenset(w["constants"])
                        known[mark[k]] = keys, [x for x in (pruned(unflat(t), keys) for t in w["trees"]) if x]
                    mine.append(known[mark[k]])
                out.append(extract(h, mine))
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}

        return kernel

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return _tables.scan_texts(joined, html, fields, make, keep=pages.columns, also=(*sides, *(f"{c}_w" for c in sides)))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_tables.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
