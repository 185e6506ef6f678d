"""Main text of web pages, by differencing pages of neighbouring URLs.

Pages stand in the order of host, URL path and content; equal pages next to each other are a run. Each page is
paired with the page before or after its run whose path has the longer prefix in common, past copies of itself, however many:
on either side the nearest run of the host that isn't a copy counts. The text lines of both are aligned by a longest
common subsequence, and lines that they share are deleted: a template repeats, an article doesn't. Lines inside a
marked article are never deleted (copies of an article, or of its paragraphs, would vanish), and marked
boilerplate goes even where a page has no neighbour.

Pages are dealt out by ranges of that order, so that even one host's or one URL's pages are shared out. A range also gets the
pages next to it, so no result depends on where a range ends. Where REACH runs on a side are all copies, the search goes on
from range to range to the host's end before texts are made (`onward`).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.llm.frames import discard, stored, widened
from datagauge.llm.kernels import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE = frozenset("head nav footer aside form menu dialog button select fieldset label object canvas audio video map".split())
HINTS = frozenset("ad ads advert adverts advertisement banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice popup modal promo sponsor sponsored share sharing social comment comments respond disqus related newsletter subscribe footer masthead pagination pager widget toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
LINE, IN_ARTICLE, IN_MAIN = 0, 1, 2
#: Of two copies one has all but this share of its characters in lines that the other has too. So many runs of pages are looked at on either
#: side before the search goes on by stretches of STRETCH runs.
COPY, REACH, STRETCH = 0.1, 8, 64
#: Texts are sent on once there are so many characters.
SENT = 4_000_000


def hinted(attributes: str, whole: bool = False) -> bool:
    """Whether attributes mark boilerplate: a class or id of which a part is a hint (whole: all of it), unless it only says what an element has."""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = [token] if whole else re.split(r"[^a-z]+", token)
                if parts[0] not in ("has", "with", "no", "without", "is") and not HINTS.isdisjoint(parts):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text lines outside marked boilerplate, in page order, and where each stands: in an article, in main, or elsewhere.

    A page without article or main of which nothing is left is read again without looking at classes and ids.
    """
    return parsed(page, True) or ([] if re.search("<(?:article|main)\\b", page, re.I) else parsed(page, False))


def parsed(page: str, hints: bool) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, skipped, place; of open elements
    parts: list[str] = []
    skipped, place, at = False, LINE, 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, place))
            parts.clear()

    def pop(to: int):
        nonlocal skipped, place
        del stack[to:]
        skipped, place = stack[-1][1:] if stack else (False, LINE)

    for m in TOKEN.finditer(page):
        if m.start() > at and not skipped:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and not skipped:
            parts.append(" ")
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            ended = ENDS.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in ended:
                    pop(i)
                elif stack[i][0] in BLOCK:
                    break
        inside = IN_ARTICLE if name == "article" or place == IN_ARTICLE else IN_MAIN if name == "main" or place == IN_MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", m["attributes"], re.I) else LINE
        gone = skipped or name in BOILERPLATE or name == "header" and place == LINE or hints and name not in ("html", "body", "main") and bool(m["attributes"].strip()) and hinted(m["attributes"], name == "article")
        stack.append((name, gone, inside))
        skipped, place = gone, inside
    if at < len(page) and not skipped and not re.match(r"</?[a-zA-Z!]", page[at:]):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of lines, by rows of bits (one integer a line)."""
    common = set(a) & set(b)
    if not common:
        return set()
    x, y = ([(i, s) for i, s in enumerate(lines) if s in common] for lines in (a, b))
    masks: dict[str, int] = {}
    for j, (_, s) in enumerate(y):
        masks[s] = masks.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for _, s in x:
        u = row & masks[s]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, j = set(), len(y)
    for i in range(len(x) - 1, -1, -1):  # back through rows: a zero bit is a step of length
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if not j:
            break
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        out.add(x[i][0])
        j -= 1
    return out


def place_of(lines: list[tuple[str, int]]) -> int:
    """Where a page's main text stands."""
    places = {p for _, p in lines}
    return next((p for p in (IN_ARTICLE, IN_MAIN) if p in places), LINE)


def main_text(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """Lines of articles if the page marks any; else those of main, or of the page, less what the neighbour has too."""
    best = place_of(lines)
    gone = shared([s for s, _ in lines], [s for s, _ in neighbour]) if neighbour and best != IN_ARTICLE else set()
    return "\n\n".join(s for i, (s, p) in enumerate(lines) if p == best and i not in gone)


def own_lines(lines: list[tuple[str, int]]) -> Counter:
    """The lines of a page's main text, each with its number."""
    best = place_of(lines)
    return Counter(s for s, p in lines if p == best)


def size(lines: Counter) -> int:
    return sum(len(s) * n for s, n in lines.items())


def within(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
    """Whether lines of b hold (almost) all of a's main text."""
    own = own_lines(a)
    return size(own - Counter(s for s, _ in b)) <= COPY * size(own)


@dataclass
class Run:
    """Equal pages next to each other: their lines, of each its path and whether it is this range's own, and (path, lines) found beyond REACH by side."""

    host: str
    content: int
    lines: list
    pages: list = field(default_factory=list)
    beyond: dict = field(default_factory=dict)

    def paired(self) -> bool:
        return bool(self.host and self.lines) and place_of(self.lines) != IN_ARTICLE


def copies(a: Run, b: Run) -> bool:
    return not b.lines or within(a.lines, b.lines) or within(b.lines, a.lines)


def nearest(runs: list[Run], at: int, side: int) -> tuple[tuple | None, bool]:
    """(path, lines) of the nearest run on a side (-1: before, 1: after) that isn't a copy, if it is within REACH, and whether the search ends there or at the host's end."""
    seen = runs[max(0, at - REACH) : at][::-1] if side < 0 else runs[at + 1 : at + 1 + REACH]
    found = next(((r.pages[-1 if side < 0 else 0][0], r.lines) for r in seen if not copies(runs[at], r)), None)
    return found, found is not None or len(seen) < REACH


def texts(runs: list[Run], at: int):
    """The main text of each own page of a run; those with the same path are worked out once."""
    run, last, near = runs[at], None, []
    if run.paired():
        for side in (-1, 1):
            found, ended = nearest(runs, at, side)
            near += [x for x in [found if ended else run.beyond.get(side)] if x]
    for path, own in run.pages:
        if own:
            if last is None or last[0] != path:
                last = path, main_text(run.lines, max(near, key=lambda x: prefix(x[0], path), default=(None, None))[1])
            yield last[1]


class Search:
    """A host's runs, for the nearest on a side that isn't a copy of a page, whatever the number of copies before it.

    Stretches of runs are passed as a whole if what all of them hold holds the page, or the page what any of them holds; other
    stretches are gone through run by run, so what is found is what a look at each run would find.
    """

    def __init__(self, runs: list[Run]):
        self.runs = [r for r in runs if r.lines]  # a page without text is nobody's neighbour
        self.firsts = [(r.pages[0][0], r.content) for r in self.runs]
        self.whole = [Counter(s for s, _ in r.lines) for r in self.runs]
        self.own = [own_lines(r.lines) for r in self.runs]
        self.stretches = []
        for low in range(0, len(self.runs), STRETCH):
            every, some = self.whole[low].copy(), Counter()
            for whole, own in zip(self.whole[low : low + STRETCH], self.own[low : low + STRETCH], strict=True):
                every &= whole
                some |= own
            self.stretches.append((every, some, min(size(x) for x in self.own[low : low + STRETCH])))

    def nearest(self, lines: list[tuple[str, int]], side: int, first: tuple[str, int]) -> Run | None:
        """On a side of the run that begins at `first` (path, content), which may stand in another range."""
        whole, own = Counter(s for s, _ in lines), own_lines(lines)
        at = bisect_right(self.firsts, first) if side > 0 else bisect_left(self.firsts, first) - 1
        spare, entered = COPY * size(own), None
        while 0 <= at < len(self.runs):
            if at // STRETCH != entered:
                entered = at // STRETCH
                every, some, least = self.stretches[entered]
                if size(own - every) <= spare or size(some - whole) <= COPY * least:
                    at = (entered + 1) * STRETCH if side > 0 else entered * STRETCH - 1
                    continue
            if size(own - self.whole[at]) > spare and size(self.own[at] - whole) > COPY * size(self.own[at]):
                return self.runs[at]
            at += side
        return None


def prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


#: Where a page stands: host, path, a hash of the html, and one of the whole row, which parts copies of one URL.
KEY = ("host", "path", "content", "row")


def keyed(pages: DataFrame, page: str, url: str, kept: list[str]) -> DataFrame:
    """(host, path, content, row, page, own) of pages; own has the kept columns."""
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    return pages.select(host.alias("host"), path.alias("path"), F.xxhash64(f"`{page}`").alias("content"), F.xxhash64(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{page}`").alias("page"), own.alias("own"))


def outline(keys: DataFrame, parts: int) -> list[tuple[tuple, list[tuple]]]:
    """Of each of about `parts` ranges of keys, in order: its first key, and its first and last REACH + 1 runs as (host, content, first path, last path)."""

    def run(batches):
        import pyarrow as pa

        first, runs = None, []
        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in KEY), strict=True):
                first = first or key
                if runs and runs[-1][:2] == (key[0], key[2]):
                    runs[-1] = (*runs[-1][:3], key[1])
                    continue
                runs.append((key[0], key[2], key[1], key[1]))
                if len(runs) > 2 * (REACH + 1):  # those in the middle have no say
                    del runs[REACH + 1]
        if first:
            kinds = pa.list_(pa.struct([("host", pa.string()), ("content", pa.int64()), ("low", pa.string()), ("high", pa.string())]))
            rows = [{"host": h, "content": c, "low": a, "high": z} for h, c, a, z in runs]
            yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in first), pa.array([rows], kinds)], names=[*KEY, "runs"])

    ranges = keys.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(run, "host string, path string, content bigint, row bigint, runs array<struct<host:string,content:bigint,low:string,high:string>>")
    return sorted(((r.host, r.path, r.content, r.row), [tuple(x) for x in r.runs]) for r in ranges.collect())  # one row a range


def guests(ranges: list[tuple[tuple, list[tuple]]]) -> list[tuple]:
    """(host, path, content, range, after) of the pages next to each range: those of REACH runs of its host on either side."""
    out = set()
    for side in (False, True):  # before a range, after it
        step = 1 if side else -1
        for at in range(len(ranges)):
            own = ranges[at][1][-1 if side else 0]
            seen, to = [own[:2]], at + step
            while 0 <= to < len(ranges) and len(seen) <= REACH:
                for host, content, low, high in ranges[to][1][::step]:
                    if host != own[0] or len(seen) > REACH:
                        break
                    if (host, content) != seen[-1]:
                        seen.append((host, content))
                        out.add((host, low if side else high, content, at, side))
                else:
                    to += step
                    continue
                break
    return sorted(out)


def marked(source: DataFrame) -> DataFrame:
    """KEY of pages, and whether the text of a page hangs on its neighbours."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "page"):
            alone = [Run(host, 0, lines_of(page or "") if host else []).paired() for host, page in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.array(alone, pa.bool_())], names=[*KEY, "paired"])

    return source.select(*KEY, "page").mapInArrow(run, "host string, path string, content bigint, row bigint, paired boolean")


def windows(batches, taken):
    """(runs, place) of each run of a range's pages once the REACH runs on either side stand with it, None after each slice; taken() gets slices, and which rows are own."""
    runs: list[Run] = []  # of one host: REACH that are settled, then those that wait for pages after them
    todo = 0

    def settle(leave):
        nonlocal todo
        while len(runs) - todo > leave:
            yield runs, todo
            todo += 1
            if todo > REACH:
                runs.pop(0)
                todo -= 1

    for batch in slices(batches, "page"):
        mine = batch.column("side").to_numpy() == 0
        taken(batch, mine)
        pages_ = batch.column("page")
        beyond = [(side, batch.column(name)) for side, name in ((-1, "before"), (1, "after")) if batch.column(name).null_count < batch.num_rows]
        for i, (host, path, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in KEY[:3]), strict=True)):
            if not runs or runs[-1].host != host or runs[-1].content != content:
                if runs and runs[-1].host != host:
                    yield from settle(0)
                    runs.clear()
                    todo = 0
                runs.append(Run(host, content, lines_of(pages_[i].as_py() or "")))
                yield from settle(REACH + 1)
            runs[-1].pages.append((path, bool(mine[i])))
            for side, column in beyond:
                if column[i].is_valid:
                    found = column[i].as_py()
                    runs[-1].beyond[side] = found["path"], [(s, LINE) for s in found["lines"].split("\n")]
        yield None
    yield from settle(0)


#: A page whose search goes on: its run begins at path and content; its lines, joined by \n, and the place of each; the range to look at.
ASKED = "host string, path string, content bigint, side int, target int, lines string, places string"


def unsettled(dealt: DataFrame) -> DataFrame:
    """ASKED of the runs of dealt pages that have REACH copies on a side."""

    def run(batches):
        import pyarrow as pa

        to: list[int] = []  # the range: all own rows have the same
        rows: list[tuple] = []

        def taken(batch, mine):
            to[:] = batch.column("target").slice(0, 1).to_pylist()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["host", "path", "content", "side", "target", "lines", "places"])

        for step in windows(batches, taken):
            if step is None:
                if rows:
                    yield sent()
                    rows.clear()
                continue
            runs, at = step
            first = next((path for path, own in runs[at].pages if own), None)
            if first is not None and runs[at].paired():
                said, places = "\n".join(s for s, _ in runs[at].lines), "".join(str(p) for _, p in runs[at].lines)
                rows += [(runs[at].host, first, runs[at].content, side, to[0], said, places) for side in (-1, 1) if not nearest(runs, at, side)[1]]
        if rows:
            yield sent()

    return dealt.mapInArrow(run, ASKED)


def onward(own: DataFrame, asked: DataFrame, ranges: list[tuple[tuple, list[tuple]]]) -> tuple[DataFrame, list[DataFrame]]:
    """(host, path, content, before, after) of what asked pages find, each (path, lines) or null, and the stored tables that it reads.

    Pages go to the pages of their host in their own range, those that find only copies there to the next range of the host, and so on.
    """
    spark = own.sparkSession
    steps = []  # where a host goes on
    for at in range(len(ranges) - 1):
        if ranges[at][1][-1][0] == ranges[at + 1][1][0][0]:
            steps += [(at, 1, ranges[at][1][-1][0], at + 1), (at + 1, -1, ranges[at][1][-1][0], at)]
    steps = spark.createDataFrame(steps, "target int, side int, host string, to int")

    def run(batches):
        import pyarrow as pa

        runs: list[Run] = []
        search = None
        for batch in slices(batches, "page"):
            taken, found = [], []
            for i, (host, path, content, side, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "content", "side", "places")), strict=True)):
                page = batch.column("page")[i].as_py() or ""
                if runs and runs[0].host != host:
                    runs, search = [], None
                if side == 0:  # a page of the range; those asked come after all pages of their host
                    if not runs or runs[-1].content != content:
                        runs.append(Run(host, content, lines_of(page)))
                    runs[-1].pages[1:] = [(path, True)]
                    continue
                search = search or Search(runs)
                near = search.nearest(list(zip(page.split("\n"), map(int, places), strict=True)), side, (path, content))
                taken.append(i)
                found.append(near and {"path": near.pages[-1 if side < 0 else 0][0], "lines": "\n".join(s for s, _ in near.lines)})
            if taken:
                rows = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("host", "path", "content", "side", "target", "page", "places")), pa.array(found, pa.struct([("path", pa.string()), ("lines", pa.string())]))], names=["host", "path", "content", "side", "target", "lines", "places", "found"])

    settled = []
    while True:
        there = own.join(asked.select("target", "host").distinct(), ["target", "host"], "left_semi")
        there = there.select("host", "path", "content", F.lit(0).alias("side"), "target", "page", F.lit("").alias("places"))
        both = there.unionByName(asked.withColumnRenamed("lines", "page")).repartitionById(len(ranges), F.col("target"))
        looked = both.sortWithinPartitions("host", F.col("side") != 0, "path", "content").mapInArrow(run, ASKED + ", found struct<path:string,lines:string>")
        settled.append(stored(looked, "beyond"))
        left = settled[-1].where("found is null").join(F.broadcast(steps), ["target", "side", "host"])
        asked = left.select("host", "path", "content", "side", F.col("to").alias("target"), "lines", "places")
        if not asked.limit(1).count():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    sides = [F.max(F.when(F.col("side") == side, F.col("found"))).alias(name) for side, name in ((-1, "before"), (1, "after"))]
    out = stored(found.where("found is not null").groupBy("host", "path", "content").agg(*sides), "beyond")
    return out, settled


def extract(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """Rows of pages without the html, with text (the main text, lines joined by two \\n) and n_chars.

    Null and empty pages have the text "". Pages without a host in their URL are paired with none, as is the only page of a host.
    Ties go to the page before. Repeated rows are pages of their own. A page without marked article whose host has only copies of it
    keeps all its lines, as does one of which less than COPY of the main text is its own. Pages of any length are read whole. Columns named text or n_chars are replaced.
    The driver holds the URLs of 18 pages a range. Hosts of pages whose text hangs on neighbours are read again, to see which pages have
    REACH copies on a side; those take one round for each range that their copies fill.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    source = keyed(pages, page, url, kept)
    # as many ranges as it takes tasks to read the pages: keys alone are too small to go by
    keys = stored(marked(source), "keys")
    ranges = outline(keys.select(*KEY), max(pages.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kinds = source.schema["own"].dataType
    bounds = [key for key, _ in ranges][1:]
    near = spark.createDataFrame(guests(ranges), "host string, path string, content bigint, target int, after boolean")

    @F.pandas_udf("int")
    def target(host, path, content, row):
        import pandas as pd

        return pd.Series([bisect_right(bounds, key) for key in zip(host, path, content, row, strict=True)], dtype="int32")

    def run(batches):
        import pyarrow as pa

        held = 0
        waiting: list = []  # rows of own pages that aren't sent yet, without html
        made: list[str] = []

        def taken(batch, mine):
            if mine.any():
                waiting.append(pa.RecordBatch.from_arrays([batch.column("own").take(pa.array(mine.nonzero()[0]))], names=["own"]))  # a copy: the html isn't held

        def sent():
            nonlocal waiting, made
            if made:
                rows = pa.Table.from_batches(waiting)
                waiting, ready = rows.slice(len(made)).to_batches(), made
                made = []
                yield from finished(rows.slice(0, len(ready)), ready)

        for step in windows(batches, taken):
            for text in texts(*step) if step else ():
                made.append(text)
                held += len(text)
                if held > SENT:
                    held = 0
                    yield from sent()
            if step is None:
                yield from sent()
        yield from sent()

    def finished(rows, made):
        import pyarrow as pa

        own = rows.column("own").combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=[*kept, "text", "n_chars"])

    own = source.withColumn("target", target(*KEY)).withColumn("side", F.lit(0))
    context = source.join(F.broadcast(near), ["host", "path", "content"]).groupBy("host", "path", "content", "target", "after").agg(F.max("page").alias("page"))
    context = context.select(*KEY[:3], F.lit(0).cast("bigint").alias("row"), "page", F.lit(None).cast(kinds).alias("own"), "target", F.expr("if(after, 1, -1)").alias("side"))
    kind = "struct<path:string,lines:string>"

    def dealt(own, context):
        both = own.unionByName(context.withColumn("before", F.lit(None).cast(kind)).withColumn("after", F.lit(None).cast(kind)))
        # side puts the guests before a range first and those after it last, whatever their row
        return both.repartitionById(max(len(ranges), 1), F.col("target")).sortWithinPartitions("side", *KEY)

    bare = own.withColumn("before", F.lit(None).cast(kind)).withColumn("after", F.lit(None).cast(kind))
    hosts = keys.groupBy("host").agg(F.max("paired").alias("paired"), F.count("*").alias("pages")).where(f"paired and pages > {REACH}").select("host")
    if hosts.limit(1).count():
        some = [x.join(hosts, "host", "left_semi") for x in (bare, context)]
        asked = stored(unsettled(dealt(*some).select(*KEY[:3], "side", "target", "page", "before", "after")), "asked")
        if asked.limit(1).count():
            found, spent = onward(own, asked, ranges)
            bare = own.join(found, ["host", "path", "content"], "left")
            for df in spent:
                discard(df)
        discard(asked)
    discard(keys)
    schema = widened(kinds.fields, [("text", "string"), ("n_chars", "bigint")])
    return dealt(bare, context).select(*KEY[:3], "side", "page", "own", "before", "after").mapInArrow(run, schema)
