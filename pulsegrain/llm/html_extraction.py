"""Main text of a page as its maximum-scoring subsequence of words and tags.

A page is a row of words and tags.  Words score by where they stand (positive in content), tags
negatively; a linear scan finds the contiguous stretch with the highest sum.  Weights are smoothed log
odds of standing inside the article, counted on labelled pages: those of a bounded sample
(`sample_pages`) that mark their article themselves.  The stretch's text is given in blocks, parted by
two line feeds, without what never belongs to an article: scripts, styles, menus, forms, asides,
adverts, comments of readers.

Defined results: null, empty and wordless pages have an empty text; without labelled pages fixed
weights stand in; unclosed tags at the end of a page are dropped; unknown character references stay as
they are; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Element names of the markup language by role.
BLOCKS = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = set("article aside body div dialog footer form head header main nav section".split())
NEVER = set("aside button datalist dialog footer form head iframe nav noscript object select svg template textarea title".split())
RAW = "script|style|noscript|template|textarea|iframe"
#: Words in a class or id that mark what stands beside an article.
BESIDE = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|comment-list|consent|cookies?|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|pagination|popup|promo|recommended|related|replies|share|sharing|sidebar|social|sponsored|subscribe|taboola|toolbar|widget)(?:$|[-_ ])", re.I)

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z|(?=<))|[^<]+|<", re.S | re.I)
MARKER = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

Token = tuple[str, str, int, bool, str]


def tokens(page: str) -> list[Token]:
    """(feature, block break or word text, words, usable, innermost block) of every tag and text."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool, str, bool]] = [("", "", True, "", False)]  # name, section, usable, innermost block, within an article
    opened: Counter[str] = Counter()  # names in the stack, so that a closing tag without one costs nothing
    for m in TOKEN.finditer(page):
        name = (m["name"] or "").lower()
        if not name:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                words = entities.unescape(piece)
                _, section, usable, inner, _ = stack[-1]
                out.append((f"w {section} {inner}", words, len(words.split()), usable, inner))
            elif m["raw"]:
                out.append((f"t {m['raw'].lower()}", "", 0, False, ""))
            continue
        mark = "\n" if name in BLOCKS else " " if name == "br" else ""
        out.append((f"t {m['close']}{name}", mark, 0, True, ""))
        if m["close"]:
            while opened[name]:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == name:
                    break
        elif name not in VOID and not m["rest"].endswith("/"):
            if name == "p" or name == "li":
                while stack[-1][0] == name or (stack[-1][0] not in BLOCKS and any(s[0] == name for s in stack[-4:])):
                    opened[stack.pop()[0]] -= 1
            _, section, usable, inner, within = stack[-1]
            beside = any(BESIDE.search(" ".join(x)) for x in MARKER.findall(m["rest"]))
            usable = usable and not beside and name not in NEVER and (name != "header" or within)
            section = (f"{name}-beside" if beside else name) if name in SECTIONS else section
            stack.append((name, section, usable, name if name in BLOCKS else inner, within or name in ("article", "main")))
            opened[name] += 1
    return out


def _labelled(parts: list[Token]) -> tuple[int, int] | None:
    """The stretch of tokens of the page's only article element."""
    for name in ("article", "main"):
        begin = [k for k, t in enumerate(parts) if t[0] == f"t {name}"]
        end = [k for k, t in enumerate(parts) if t[0] == f"t /{name}"]
        if len(begin) == 1 and len(end) == 1 and begin[0] < end[0]:
            return begin[0], end[0]
    return None


class Weights:
    def __init__(self, counts: dict[str, tuple[int, int]] | None = None):
        self.known: dict[str, float] = {}
        counts = counts or {}
        total_in = sum(i for f, (i, _) in counts.items() if f[0] == "w") or 1
        total_out = sum(o for f, (_, o) in counts.items() if f[0] == "w") or 1
        for feature, (inside, outside) in counts.items():
            odds = math.log((inside + 0.5) / (total_in + 1)) - math.log((outside + 0.5) / (total_out + 1))
            if feature[0] == "w":
                self.known[feature] = max(-3.0, min(3.0, odds))
            else:  # tags are negative, the more so the more they stand outside
                self.known[feature] = -0.1 - max(0.0, math.log((outside + 0.5) / (inside + 0.5)))

    def of(self, feature: str, usable: bool) -> float:
        found = self.known.get(feature)
        if found is None:
            found = (1.0 if usable else -1.0) if feature[0] == "w" else -0.5
        return min(found, -0.5) if feature[0] == "w" and not usable else found


def extract(page: str, weights: Weights) -> str:
    """The text of the best stretch."""
    parts = tokens(page)
    best = total = 0.0
    begin = low = high = 0
    for k, (feature, _, words, usable, _) in enumerate(parts):
        value = weights.of(feature, usable)
        total += value * words if feature[0] == "w" else value
        if total <= 0.0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, low, high = total, begin, k + 1
    blocks, now = [], []
    for feature, text, _, usable, _ in parts[low:high]:
        if feature[0] == "w":
            if usable:
                now.append(text)
        elif text == "\n":
            blocks.append(now)
            now = []
        elif text:
            now.append(text)
    blocks.append(now)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(line for line in lines if line)


def train(pages: DataFrame, sample_pages: int = 3000, features: int = 4096, id_column: str = "page_id", html_column: str = "html") -> Weights:
    """Counts features inside and outside articles on about sample_pages pages, chosen by a hash of their id."""
    share = max(1, -(-pages.count() // sample_pages))
    chosen: Column = F.pmod(F.xxhash64(id_column), F.lit(share)) == 0

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        inside, outside = Counter(), Counter()
        for page in batch.column(0).to_pylist():
            parts = tokens(page or "")
            at = _labelled(parts)
            if at:
                for k, (feature, _, words, _, _) in enumerate(parts):
                    (inside if at[0] < k < at[1] else outside)[feature] += words if feature[0] == "w" else 1
        names = sorted(inside.keys() | outside.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["feature", "inside", "outside"])

    counted = map_batches(pages.where(chosen), [html_column], "feature string, inside long, outside long", run)
    top = counted.groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "feature").limit(features).collect()
    return Weights({r["feature"]: (r["i"], r["o"]) for r in top})


def main_text(pages: DataFrame, weights: Weights, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, text and its number of code points."""
    kind, link = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [extract(page, weights) if page else "" for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_column, url_column, "text", "n_chars"])

    return map_batches(pages, [id_column, url_column, html_column], f"{id_column} {kind}, {url_column} {link}, text string, n_chars long", run)
