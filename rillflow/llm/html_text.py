"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read as a stream of tags (malformed ones included) into leaf blocks: the text between two block-level tags,
with the chain of open elements above it. A block's features are its ancestors' tags, the words in their class, id and
role, and the shape of its text. The field has two states (main, other), weights per feature and state and per
transition; it is trained by gradient ascent of the likelihood on labelled pages (html_train) and decoded by Viterbi.

Defined results: a null or empty page, or one without main text, gives the empty string; repeated pages are each
extracted, alike; whole pages are read whatever their length or depth; a comment or tag that the page does not end is no
text; other columns are not used. A head without an end tag ends where the body or
anything that cannot stand in a head begins. White space in a block
(including <br>) becomes one space, character references are decoded, blocks are joined by one line feed in page order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import html_train
from rillflow.llm.common import slices, table

#: Fixed values of HTML: elements that stand as blocks, that have no end tag, and whose text is not shown.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul button label select option textarea video audio iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript svg head title iframe object canvas".split())
#: What may stand in a head; any other element, and any text of its own, ends a head that is still open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An open element of the first kind is closed by the start of one of the second, as the HTML standard has it.
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag does not reach beyond these, but its own.
BARRIERS = ("body", "html", "table")
#: Tags within an article that tell what is not its text.
UNDER = frozenset("nav aside footer header form section div".split())
#: What is left of a page that ends within a comment, declaration or tag.
UNENDED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
LENGTHS = (20, 60, 120, 300, 800)
HASHED = 1 << 12
EPOCHS = 150
#: Features whose weights a worker remembers before it starts afresh.
HELD = 100_000
#: Bytes of files, as they lie compressed, that a task reads about.
TASK_BYTES = 4 << 20


class Element:
    """An open element, with what its leaves need to know of the elements around it. `new` names the features that no
    element around it has, so a page's features take as much room as its tags, however deep they nest."""

    __slots__ = ("tag", "parent", "new", "block", "under", "hidden", "linked")

    def __init__(self, tag: str, parent: Element | None, new: list[str]) -> None:
        self.tag, self.parent, self.new = tag, parent, new
        shown = tag in BLOCKS and tag not in ("html", "body")
        self.block = tag if shown else parent.block if parent else ""
        self.under = frozenset() if tag in ("article", "main") else parent.under if parent else None
        if self.under is not None and tag in UNDER:
            self.under |= {tag}
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)
        self.linked = tag == "a" or bool(parent and parent.linked)


class _Leaves(HTMLParser):
    """Collects (innermost open element, text, characters inside links). Every step costs the same however deep it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.known: Counter = Counter()
        self.leaves: list[tuple[Element | None, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.leaves.append((self.stack[-1] if self.stack else None, text, self.linked))
        self.parts, self.linked = [], 0

    def _push(self, tag: str, attrs: list) -> None:
        words = re.split(r"[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower())
        own = {f"hint={w}" for w in words if w} | (set() if tag in ("html", "body") else {f"in={tag}"})
        new = sorted(f for f in own if not self.known[f])
        self.known.update(new)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, self.stack[-1] if self.stack else None, new))

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            self.known.subtract(gone.new)

    def _last(self, tag: str) -> int:
        """Where the innermost open element of that tag stands, or -1."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def _end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.flush()
            self._pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "head" and len(self.stack) > len(self.places.get("html", ())):
            return  # only the first head of a page is one
        if tag == "body":
            if self.places.get("head"):
                self._pop_to(self.places["head"][0])
        elif tag not in IN_HEAD:
            self._end_head()
        if tag in BLOCKS:
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i].tag
                if name in CLOSED_BY_BLOCK or tag in SIBLINGS.get(name, ()):
                    self._pop_to(i)
                    break
                if name in BLOCKS and name not in SIBLINGS:
                    break
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        at = self._last(tag)
        if at >= 0 and (tag in BARRIERS or at > max(map(self._last, BARRIERS))):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        inside = self.stack[-1] if self.stack else None
        if inside and inside.hidden:
            return
        self.parts.append(data)
        if inside and inside.linked:
            self.linked += len(data.strip())


def leaves(html: str) -> list[tuple[Element | None, str, int]]:
    reader = _Leaves()
    reader.feed(html)
    if UNENDED.match(reader.rawdata):  # a comment or tag that the page does not end is no text
        reader.rawdata = ""
    reader.close()
    reader.flush()
    return reader.leaves


def own_features(block: tuple[Element | None, str, int]) -> list[str]:
    """The features of a leaf that are not its ancestors' tags and hints."""
    element, text, linked = block
    share = linked / max(1, len(text))
    out = ["bias", f"leaf={element.block if element else ''}", f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"length={sum(len(text) > x for x in LENGTHS)}"]
    out.append("stop" if text[-1] in ".!?…:;。" else "nostop")
    if "©" in text:
        out.append("copyright")
    if element and element.under is not None:
        out.append("under=" + "/".join(sorted(element.under)))
    return out


def features(block: tuple[Element | None, str, int]) -> list[str]:
    out, element = own_features(block), block[0]
    while element:
        out += element.new
        element = element.parent
    return out


class Field:
    """Weights: emission (HASHED, 2), transition (2, 2), start (2)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> None:
        self.emission, self.transition, self.start = emission, transition, start
        self.held: dict[str, tuple[float, float]] = {}

    @staticmethod
    def columns(names: list[str]) -> list[int]:
        return [zlib.crc32(n.encode()) % (HASHED - 1) + 1 for n in names]

    def weight(self, names: list[str], score: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
        """score and the emission weights of features, as plain numbers: arrays of two cost more than the sums."""
        main, other = score
        for name in names:
            got = self.held.get(name)
            if got is None:
                if len(self.held) >= HELD:
                    self.held.clear()
                got = self.held[name] = tuple(self.emission[self.columns([name])[0]].tolist())
            main, other = main + got[0], other + got[1]
        return main, other

    def emissions(self, blocks: list[tuple[Element | None, str, int]]) -> np.ndarray:
        """Each block's emission scores; those of its ancestors are summed once an element."""
        known: dict[int, tuple[float, float]] = {}
        out = []
        for block in blocks:
            chain, element = [], block[0]
            while element and id(element) not in known:
                chain.append(element)
                element = element.parent
            score = known[id(element)] if element else (0.0, 0.0)
            for e in reversed(chain):
                score = known[id(e)] = self.weight(e.new, score)
            out.append(self.weight(own_features(block), score))
        return np.array(out)

    def decode(self, rows: list[list[int]]) -> list[int]:
        return self.best_path(np.array([self.emission[r].sum(0) for r in rows]))

    def best_path(self, emission: np.ndarray) -> list[int]:
        """Viterbi."""
        (aa, ab), (ba, bb) = self.transition.tolist()
        a, b = (self.start + emission[0]).tolist()
        back = []
        for ea, eb in emission[1:].tolist():
            to_a, to_b = a + aa < b + ba, a + ab < b + bb
            back.append((to_a, to_b))
            a, b = (b + ba if to_a else a + aa) + ea, (b + bb if to_b else a + ab) + eb
        path = [int(a < b)]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def train(labelled: list[list[tuple[str, bool]]], epochs: int = EPOCHS) -> Field:
    """Maximises the regularized likelihood by Adam, over all pages at once (forward-backward on padded arrays)."""
    rows, labels = [], []
    for page in labelled:
        # The page is read as a whole; a zero-width mark tells which fragment a text came from.
        html = "".join(f"{part}" if not main else re.sub(r"(^|>)([^<]+)", lambda m: m[1] + "⁣" + m[2] if m[2].strip() else m[0], part) for part, main in page)
        got = leaves(html)
        labels.append([int("⁣" in t) for _, t, _ in got])
        rows.append([Field.columns(features((s, t.replace("⁣", "") or " ", n))) for s, t, n in got])
    pages, most, wide = len(rows), max(map(len, rows)), max(len(r) for p in rows for r in p)
    x = np.zeros((pages, most, wide), np.int64)
    y = np.zeros((pages, most), np.int64)
    mask = np.zeros((pages, most), bool)
    for i, (page, own) in enumerate(zip(rows, labels, strict=True)):
        mask[i, : len(page)], y[i, : len(page)] = True, own
        for j, r in enumerate(page):
            x[i, j, : len(r)] = r
    e, t, s = np.zeros((HASHED, 2)), np.zeros((2, 2)), np.zeros(2)
    theta, m, v = [e, t, s], [np.zeros_like(a) for a in (e, t, s)], [np.zeros_like(a) for a in (e, t, s)]
    one = np.eye(2)[y]
    for epoch in range(1, epochs + 1):
        emit = e[x].sum(2)
        f, b = np.zeros((most, pages, 2)), np.zeros((most, pages, 2))
        f[0] = s + emit[:, 0]
        for j in range(1, most):
            step = np.logaddexp(f[j - 1][:, 0, None] + t[0], f[j - 1][:, 1, None] + t[1]) + emit[:, j]
            f[j] = np.where(mask[:, j, None], step, f[j - 1])
        z = np.logaddexp(f[-1][:, 0], f[-1][:, 1])
        for j in range(most - 2, -1, -1):
            nxt = emit[:, j + 1] + b[j + 1]
            step = np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None])
            b[j] = np.where(mask[:, j + 1, None], step, 0)
        p = np.exp(f + b - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        off = (one - p) * mask[:, :, None]
        ge = np.zeros_like(e)
        for k in range(2):
            ge[:, k] = np.bincount(x.ravel(), np.repeat(off[:, :, k].ravel(), wide), HASHED)
        gt = np.zeros((2, 2))
        both = mask[:, 1:]
        for i in range(2):
            for k in range(2):
                pair = np.exp(f[:-1, :, i] + t[i, k] + emit[:, 1:, k].T + b[1:, :, k] - z[None]).T * both
                gt[i, k] = ((y[:, :-1] == i) & (y[:, 1:] == k) & both).sum() - pair.sum()
        grads = [ge - 0.05 * e, gt - 0.05 * t, off[:, 0].sum(0) - 0.05 * s]
        for a, g, am, av in zip(theta, grads, m, v, strict=True):
            am += 0.1 * (g - am)
            av += 0.01 * (g * g - av)
            a += 0.1 * (am / (1 - 0.9**epoch)) / (np.sqrt(av / (1 - 0.99**epoch)) + 1e-8)
        e[0] = 0  # padding
    return Field(e, t, s)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(html_train.pages())


def main_text(html: str, field: Field) -> str:
    found = leaves(html)
    if not found:
        return ""
    states = field.best_path(field.emissions(found))
    return "\n".join(t for (_, t, _), k in zip(found, states, strict=True) if k)


def extract(df: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url"), field: Field | None = None) -> DataFrame:
    """keys and text for every row of df."""
    sent = df.sparkSession.sparkContext.broadcast(field or default_field())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h, sent.value) for h in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string())], names=[*keys, "text"])

    # Keys go through as Arrow columns, so that a null among 64-bit numbers changes none of them.
    rows = df.select(F.coalesce(F.col(html), F.lit("")).alias("_html"), *[df[k] for k in keys])
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(read, f"{kinds}, text string")


def dealt_by_size(pages: DataFrame) -> DataFrame:
    """A scan dealt out evenly, whatever its keys, over as many tasks as its files' bytes ask for and all cores at least."""
    size = pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, int(str(size)) // TASK_BYTES + 1))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The Python work costs far more than the shuffle, and a table may be one file.
    pages = dealt_by_size(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
