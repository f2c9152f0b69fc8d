"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; runs of text between block borders are the leaves.
Every node is content or not. Its tag, class words, length, share of linked text and sentence marks
give it a potential, and parent and child are joined by another one. Messages go from the leaves to
the root and back (sum-product, exact on a tree), which yields each node's marginal; runs with a
marginal above one half are the text.

The potentials are counts over labelled pages: layouts written here with their labels, and a sample
of at most about ``max_pages`` of the given pages that mark their article themselves. Every page is
then extracted whole.

Cases: null and empty pages, and pages without text, give an empty text; broken markup is read as
far as it goes (open elements end with the page); repeated rows are extracted alike.
Other columns are not looked at, whatever their names. A page is read whole, in time proportional to its length.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

MAX_PAGES = 2000
#: Features of a node overlap, so each counts for half.
TEMPER = 0.5

# Element names of the HTML standard.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe select button object head".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Class and id words that say what an element is for.
AWAY = re.compile(
    r"\b(?:ads?|adverts?|advertisement|banner|breadcrumbs?|byline-links|comments?|consent|cookies?|copyright|disclaimer|disqus"
    r"|dialog|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup"
    r"|promo|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe"
    r"|tags|toolbar|widget|alert)\b"
)
TOWARDS = re.compile(r"\b(?:article|article-body|body|content|entry|entry-content|main|post|post-content|story|text)\b")
MARKS_OUT = {"nav", "aside", "footer", "header", "form", "menu", "dialog"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)", re.S
)
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-main\s*=\s*[\"']?([01])")


class Node:
    __slots__ = ("parent", "tag", "mark", "chars", "linked", "sentences", "pieces", "runs", "role", "within")

    def __init__(self, parent, tag, words="", mark=None, within=""):
        self.parent, self.tag, self.mark, self.within = parent, tag, mark, within
        spaced = words + " " + words.replace("-", " ")
        self.role = (
            "away" if tag in MARKS_OUT or (words and AWAY.search(spaced))
            else "towards" if words and TOWARDS.search(spaced) else "named" if words else ""
        )
        self.chars = self.linked = self.sentences = self.runs = 0
        self.pieces = None


def parse(page):
    """Nodes in page order, parents first; leaves (tag ``#text``) hold the pieces of a run of text."""
    nodes = [Node(-1, "#root")]
    stack, leaf, links, at = [0], -1, 0, 0
    size = len(page)
    lowered, never_closed = None, set()
    open_at = {}  # per tag the places in the stack of its open elements

    def close(place):
        """End the open element at a place in the stack, and those inside it."""
        for i in reversed(stack[place:]):
            open_at[nodes[i].tag].pop()
        del stack[place:]

    def say(text):
        nonlocal leaf
        text = html.unescape(text)
        if leaf < 0:
            if not text.strip():
                return
            nodes.append(Node(stack[-1], "#text", within=nodes[stack[-1]].role))
            leaf = len(nodes) - 1
            nodes[leaf].pieces = []
        node = nodes[leaf]
        node.pieces.append(text)
        n = len(text.strip())
        node.chars += n
        node.linked += n if links else 0

    # No tag can end behind the last ">", so none is looked for there: each sign is read a bounded number of times.
    last = page.rfind(">") + 1
    while at < size:
        token = TOKEN.search(page, at, last) if at < last else None
        if token is None:
            comment = page.find("<!--", at)  # one that never ends
            say(page[at:] if comment < 0 else page[at:comment])
            break
        if token.start() > at:
            say(page[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            if token[0].startswith("<!--") and not token[0].endswith("-->", 4):
                break
            continue
        name = name.lower()
        if token[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                leaf = -1
                if open_at.get(name):
                    close(open_at[name][-1])
            continue
        rest = token[3]
        if name in RAW:
            if name != "head" and name not in never_closed:
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find("</" + name, at) if len(lowered) == size else page.find("</" + name, at)
                if end >= 0:
                    at = end
                elif name in ("script", "style", "textarea", "title"):
                    at = size
                else:
                    never_closed.add(name)
            continue
        if name == "br":
            say(" ")
        elif name == "a":
            links += 1
        elif name in BLOCK:
            leaf, links = -1, 0
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                nearest = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
                own = nearest(CLOSES[name])
                if own > nearest(CONTAINERS[name]):
                    close(own)
            named = " ".join(next(filter(None, m.groups()), "") for m in NAMED.finditer(rest)).lower().replace("_", "-")
            mark = LABEL.search(rest) if "data-main" in rest else None
            nodes.append(Node(stack[-1], name, named, mark and int(mark[1]), nodes[stack[-1]].role))
            if name not in VOID:
                open_at.setdefault(name, []).append(len(stack))
                stack.append(len(nodes) - 1)
    for node in reversed(nodes[1:]):
        if node.pieces is not None:
            node.pieces = " ".join("".join(node.pieces).split())
            node.sentences = int(node.pieces[-1:] in ".!?:;\"'”…" if node.pieces else 0)
            node.runs = 1
        up = nodes[node.parent]
        up.chars += node.chars
        up.linked += node.linked
        up.sentences += node.sentences
        up.runs += node.runs
    return nodes


def features(node):
    """Names of what can be seen of a node."""
    density = node.linked / node.chars if node.chars else 0
    kind = "t" if node.pieces is not None else "e"
    size = min(10, node.chars.bit_length())
    found = [
        f"{kind}:size:{size}",
        f"{kind}:links:{min(4, math.ceil(density * 4))}",
        f"{kind}:sentences:{math.ceil(4 * node.sentences / node.runs) if node.runs else 0}",
    ]
    if node.role:
        found.append(f"role:{node.role}")
    if node.within:
        found.append(f"{kind}:within:{node.within}")
    return found


def place(node):
    """What the potential of parent and child depends on: the tag, and whether nothing is above it."""
    return f"{node.tag} alone" if node.parent == 0 else node.tag


def labels_of(nodes):
    """1 for content nodes by explicit marks, else by the page's own article; None if it has neither."""
    explicit = any(n.mark is not None for n in nodes)
    if not explicit and sum(n.tag in ("article", "main") for n in nodes) == 0:
        return None
    labels = []
    for node in nodes:
        own = labels[node.parent] if labels else 0
        if explicit:
            own = own if node.mark is None else node.mark
        elif node.role == "away":
            own = -1
        elif own == 0 and node.tag in ("article", "main"):
            own = 1
        labels.append(own)
    return [max(0, x) for x in labels]


def count_page(nodes, labels, counts, times=1):
    """Add a labelled page to the counts of (feature, label) and (parent's label, label)."""
    for node, label in zip(nodes, labels):
        if node.parent >= 0:
            for name in features(node):
                counts[name, label] = counts.get((name, label), 0) + times
            counts["node", label] = counts.get(("node", label), 0) + times
            edge = f"child of {labels[node.parent]}:{place(node)}"
            counts[edge, label] = counts.get((edge, label), 0) + times


def layouts():
    """Labelled pages of the usual builds: what stands where, with text of varied length."""
    syllables = "ra te lo mi su an der ing on est ver al ti no pe".split()

    def text(seed, n):
        words, x = [], seed * 7919 + 13
        for _ in range(n):
            x = (x * 48271 + 11) % 2147483647
            words.append("".join(syllables[(x >> s) % len(syllables)] for s in range(0, 4 * (1 + x % 3), 4)))
        return " ".join(words)

    sentence = lambda seed, n: text(seed, n).capitalize() + "."
    pages = []
    for k in range(24):
        links = lambda n, s=0: "".join(f'<li><a href="#">{text(k * 31 + i + s, 1 + i % 3)}</a></li>' for i in range(n))  # noqa: B023,E731
        paragraphs = "".join(
            f"<p>{sentence(k * 17 + i, 6 + 19 * ((i + k) % 5))}" + (f' <a href="#">{text(i, 2)}</a> {sentence(i, 9)}' if i % 3 == 1 else "") + "</p>"
            for i in range(1 + k % 7)
        )
        body = f"<h1>{text(k, 5)}</h1>{paragraphs}<h2>{text(k + 5, 3)}</h2><ul><li>{sentence(k, 8)}</li><li>{sentence(k + 1, 11)}</li></ul>"
        body += f"<blockquote><p>{sentence(k + 9, 14)}</p></blockquote>" if k % 2 else f"<p>{sentence(k + 8, 30)}</p>"
        short = f"<h1>{text(k, 4)}</h1><p>{sentence(k, 4)}</p>"
        body = short if k % 8 == 7 else body + f"<p>{sentence(k, 1)}</p>" * (k % 3) + f"<p>{sentence(k + 2, 2)}</p>" * (k % 2)
        comments = "".join(f'<div class="comment"><p>{text(i, 2)}</p><p>{sentence(i + k, 12)}</p></div>' for i in range(3))
        comments = f'<div id="comments" class="comments" data-main="0"><h3>{text(k, 2)}</h3>{comments}</div>'
        form = f'<form data-main="0"><label>{text(k, 2)}</label><p>{sentence(k, 6)}</p></form>'
        aside = f'<aside class="sidebar" data-main="0"><h3>{text(k, 2)}</h3><ul>{links(4)}</ul><p>{sentence(k, 10)}</p></aside>'
        related = f'<div class="related" data-main="0"><h4>{text(k, 2)}</h4><ul>{links(3, 5)}</ul></div>'
        notice = f'<div class="notice cookie" data-main="0"><p>{sentence(k + 3, 16)}</p></div>'
        advert = f'<div class="ad" data-main="0">{sentence(k + 4, 9)}</div>'
        nav, foot = f"<nav><ul>{links(6)}</ul></nav>", f"<footer><p>{text(k, 6)}</p><ul>{links(2)}</ul></footer>"
        head = f'<header><div class="logo">{text(k, 2)}</div>{nav}</header>'
        inner = (advert if k % 3 == 0 else "") + (related if k % 3 == 1 else "") + (comments if k % 3 == 2 else "")
        pages += [
            f'{head}<article data-main="1">{body}{inner}</article>{aside}{form}{foot}',
            f'{notice}{head}<main data-main="1"><div>{body}</div>{form}</main>{comments}{foot}',
            f'<div id="header"><p>{text(k, 3)}</p><ul class="menu">{links(5)}</ul></div><div id="wrapper"><div class="content" data-main="1">'
            f'{body}</div>{related}<div class="sidebar"><p>{sentence(k, 7)}</p><ul>{links(4)}</ul></div></div><div id="footer">{text(k, 8)}</div>',
            f'{nav}{advert}<section class="post" data-main="1">{body}</section>{comments}{form}{foot}',
            f'<table><tr><td><ul>{links(5)}</ul></td><td data-main="1">{body}</td></tr></table><p>{text(k, 7)}</p>',
            f'{nav}<div data-main="1">{body}</div>{notice}{aside}{foot}',
        ]
        if k % 6 == 0:  # paragraphs that nothing holds together
            loose = body.replace("<h1>", '<h1 data-main="1">').replace("<h2>", '<h2 data-main="1">').replace("<p>", '<p data-main="1">')
            pages.append(f'{nav}{loose.replace("<ul>", '<ul data-main="1">').replace("<blockquote>", '<blockquote data-main="1">')}{advert}{foot}')
    pages = [f'<html><body data-main="0">{p}</body></html>' for p in pages]
    for k in range(6):  # fragments without a page around them
        pages.append("".join(f'<p data-main="1">{sentence(k + i, 3 + 9 * i)}</p>' for i in range(1 + k % 3)))
        pages.append(f'<div data-main="1">{sentence(k, 8)}<p>{sentence(k, 12)}</p></div>')
    return pages


def potentials(counts):
    """Log odds of each feature, and for each tag how often a child is content given its parent's label."""
    total = [counts.get(("node", y), 0) + 1 for y in (0, 1)]
    names = {f for f, _ in counts if f != "node" and not f.startswith("child of")}
    odds = {
        f: TEMPER * (math.log((counts.get((f, 1), 0) + 0.5) / (total[1] + 1)) - math.log((counts.get((f, 0), 0) + 0.5) / (total[0] + 1)))
        for f in names
    }
    given = {}
    for tag in {f.partition(":")[2] for f, _ in counts if f.startswith("child of")} | {""}:
        shares = []
        for parent in (0, 1):
            n = [counts.get((f"child of {parent}:{tag}", y), 0) for y in (0, 1)]
            shares.append((n[1] + (1 - parent) * 0.05 + parent * 0.95) / (sum(n) + 1))
        given[tag] = tuple(shares)
    return odds, given


def marginals(nodes, model):
    """Log odds of being content of every node: one pass up the tree and one down."""
    odds, given = model
    exp, log = math.exp, math.log
    n = len(nodes)
    belief, message = [0.0] * n, [0.0] * n
    edges = [given.get(place(node), given[""]) for node in nodes]
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        belief[i] += sum(odds.get(f, 0.0) for f in features(node))
        e = exp(max(-60.0, min(60.0, belief[i])))
        on0, on1 = edges[i]  # a child's chance to be content if the parent is not, and if it is
        message[i] = log((1 - on1 + on1 * e) / (1 - on0 + on0 * e))
        belief[node.parent] += message[i]
    down = [0.0] * n
    down[0] = -20.0  # the page itself is not content
    for i in range(1, n):
        up = nodes[i].parent
        a = exp(max(-60.0, min(60.0, down[up] + belief[up] - message[i])))
        on0, on1 = edges[i]
        down[i] = log((on0 + on1 * a) / (1 - on0 + (1 - on1) * a))
    return [d + b for d, b in zip(down, belief)]


def extract(page, model):
    """The page's main text: blocks of content, joined by an empty line."""
    nodes = parse(page)
    found = marginals(nodes, model)
    return "\n\n".join(n.pieces for n, odds in zip(nodes, found) if n.pieces and odds > 0)


def _counted(batches):
    counts = {}
    for batch in batches:
        for page in batch.column(0).to_pylist():
            nodes = parse(page or "")
            labels = labels_of(nodes)
            if labels:
                count_page(nodes, labels, counts)
    rows = [(f, y, n) for (f, y), n in counts.items()]
    columns = list(zip(*rows)) or [[]] * 3
    kinds = (pa.string(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["feature", "label", "n"])


def train(pages, max_pages=MAX_PAGES):
    """Potentials from the layouts and from a hashed sample of the pages that label themselves."""
    counts = {}
    for page in layouts():
        nodes = parse(page)
        count_page(nodes, labels_of(nodes), counts)
    own = sum(n for (f, _), n in counts.items() if f == "node")
    n = pages.count()
    part = 1_000_000 if n <= max_pages else int(1_000_000 * 0.9 * max_pages / n)
    sample = pages.filter(F.pmod(F.xxhash64("page_id", F.lit("labelled")), F.lit(1_000_000)) < part).select("html")
    found = sample.mapInArrow(_counted, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    given = sum(r["n"] for r in found if r["feature"] == "node")
    for r in found:  # the sample weighs at most half as much as the layouts, which are more varied
        key = r["feature"], r["label"]
        counts[key] = counts.get(key, 0) + r["n"] * min(1.0, own / 2 / max(1, given))
    return potentials(counts)


def main_text(pages, model=None):
    """A column of the main text; ``pages`` gives the training sample unless a model is given."""
    model = train(pages) if model is None else model

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array((extract(page.as_py() or "", model) for page in column), pa.string())

    return text(F.col("html"))
