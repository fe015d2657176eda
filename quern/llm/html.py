"""Main text of HTML pages: page structure as a prior, a host suffix array over the whole streams of all pages.

A tolerant tokenizer cuts a page into blocks in one pass. Blocks inside the
article (or main) element are its text; blocks in menus, headers, footers,
sidebars, forms, adverts, notices and comments are furniture. Blocks whose
class only half sounds like furniture, and blocks of pages without an
article, are open, and the array decides about them. An article's plain blocks
are text unless the array finds them on most pages of the host.

All token streams of a host are joined into one, and the
suffixes of the joined stream put into groups that agree in their first DEPTH
tokens: the intervals of the host's suffix array at that depth. An interval
whose suffixes come from enough distinct pages is a repeated substring. Every
token of a longer repeat lies in such a substring too, so ordering suffixes
any deeper could not change which tokens repeats cover, and groups, unlike
ranges of a sorted array, split evenly however common a repeat is. Covered
tokens are boilerplate and leave the open blocks; unique runs stay. Copies of
a page count as one page, so a copied article is no boilerplate.

Repeats of most pages of a host are looked for on all pages. A prefix on a
share of a host's pages is on that share of some worker's pages of it, so a
worker drops what none of its own pages can make a repeat of most, and no
prefix is shuffled that stands alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small, stage_table

DEPTH = 6
#: Distinct pages of a host that make a repeat: so many, or this share of the host's pages if that is more.
PAGES = 3
SHARE = 0.01
#: Share of a host's pages, and distinct pages at least, with a repeat that makes an article's plain block furniture.
MOST = 0.5
MOST_PAGES = 10
#: Prefixes that a worker counts at once.
COUNTED = 2_000_000

_COMMON = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
_LOOSE = r"<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
MARKUP = re.compile(rf"""{_COMMON}|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|{_LOOSE}""", re.S)
#: After a quote that never ends every tag ends at its first ">", so that no tag is read to the page's end again.
MARKUP_AFTER = re.compile(rf"{_COMMON}|{_LOOSE}", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp svg object canvas audio video".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rt rp img".split())
FURNITURE = frozenset("head nav footer aside form menu dialog select button fieldset datalist".split())
CONTENT = frozenset(("article", "main"))
SCOPES = frozenset("article main section div td th table body html aside nav footer header form ul ol blockquote figure button".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HINT = re.compile(
    r"ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?"
    r"|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|related|recommend\w*|widget|pager|pagination"
)
#: Words that are furniture in some names and text in others.
FAINT = re.compile(r"side|search|alert|discussion|respond|skip|notice\w+")
#: Words that say nothing about what they stand beside.
NEUTRAL = frozenset("site page main top bottom left right bar box list item items wrapper wrap container block area section inner outer global primary secondary form link links button buttons row col column group panel module unit slot text body title post posts article js is has the and to us".split())
#: Beside these, a header is the article's own.
OWN = frozenset("article entry post story content".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def hint(names: str) -> int:
    """2 if a class or id is a furniture word, beside neutral words at most; 1 if one has such a word beside others; else 0."""
    found = 0
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if OWN & set(parts) and "header" in parts:
            continue
        sure = [HINT.fullmatch(p) is not None for p in parts]
        faint = [FAINT.fullmatch(p) is not None for p in parts]
        if any(sure) and all(s or f or p in NEUTRAL for s, f, p in zip(sure, faint, parts)):
            return 2
        found = max(found, int(any(sure) or any(faint)))
    return found


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """2: furniture, 1: perhaps, 0: not by its tag."""
    if name in FURNITURE:
        return 2
    if name == "header":
        return 0 if in_article else 2
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return 0
    own = _attributes(attrs)
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return 2
    if own.get("role", "").lower() in ROLES:
        return 2
    return hint(f"{own.get('class', '')} {own.get('id', '')}")


class _Stack:
    """Open elements. Counts by scope keep every step from walking over elements that it leaves open."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int, bool]] = []  # name, furniture, whether it begins content
        self.names: Counter[str] = Counter()
        self.scopes: list[tuple[str, int, Counter[str]]] = [("", -1, Counter())]  # owner, its place, other names above it
        self.furniture = self.faint = self.articles = self.mains = 0

    def push(self, name: str, bad: int, good: bool) -> None:
        self.names[name] += 1
        if name in SCOPES:
            self.scopes.append((name, len(self.held), Counter()))
        else:
            self.scopes[-1][2][name] += 1
        self.held.append((name, bad, good))
        self._count(name, bad, good, 1)

    def _count(self, name: str, bad: int, good: bool, by: int) -> None:
        self.furniture += by * (bad == 2)
        self.faint += by * (bad == 1)
        self.articles += by * (good and name == "article")
        self.mains += by * (good and name == "main")

    def _pop_through(self, names: frozenset[str] | set[str]) -> None:
        while True:
            name, bad, good = self.held.pop()
            self.names[name] -= 1
            if name in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][2][name] -= 1
            self._count(name, bad, good, -1)
            if name in names:
                return

    def close(self, name: str) -> None:
        """An end tag: inline elements end within their scope alone."""
        if (self.scopes[-1][2] if name in INLINE else self.names)[name]:
            self._pop_through({name})

    def close_before(self, names: set[str]) -> None:
        """A start tag that ends the last of ``names`` in its scope, or the scope itself."""
        owner, _, inside = self.scopes[-1]
        if any(inside[n] for n in names) or owner in names:
            self._pop_through(names)


def blocks(html: str) -> list[tuple[str, str]]:
    """(region, text) of each block in page order; region is "article", "furniture", "open", or one of the first and last with "?" for a faint hint of furniture.

    Without any article, blocks inside main count as the article's. Linear in the page.
    """
    found: list[tuple[str, bool, str]] = []
    stack, run = _Stack(), []
    size, at, markup = len(html), 0, MARKUP

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                region = "furniture" if stack.furniture else ("article" if stack.articles else "open") + "?" * bool(stack.faint)
                found.append((region, bool(stack.mains), text))

    while at < size:
        m = markup.search(html, at)
        if m is None:
            run.append(html[at:])
            break
        if m.start() > at:
            run.append(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            run.append(entities.unescape(m["cdata"]).replace("&", "&amp;"))
            continue
        strict = markup is MARKUP and m["name"] is not None
        close, name, attrs = (m["close"], m["name"], m["attrs"]) if strict else (m["close2"], m["name2"], m["attrs2"])
        if name is None:
            continue
        if not strict:
            markup = MARKUP_AFTER
        name = name.lower()
        if name not in INLINE:
            flush()
        if close:
            stack.close(name)
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            continue
        if closing := {"p"} if name in ENDS_P else SIBLINGS.get(name):
            stack.close_before(closing)
        bad, good = _furniture(name, attrs, bool(stack.articles)), name in CONTENT
        if name not in INLINE or bad == 2:
            if bad:
                flush()
            stack.push(name, bad, good)
    flush()
    if not any(region.startswith("article") for region, _, _ in found):
        found = [(region.replace("open", "article") if main else region, main, text) for region, main, text in found]
    return [(region, text) for region, _, text in found]


def structured(page: list[tuple[str, str]]) -> bool:
    return any(region.startswith("article") for region, _ in page)


def undecided(page: list[tuple[str, str]]) -> bool:
    """Whether the array has a say: blocks inside an article are faintly hinted at, or there is no article."""
    return any(region == "article?" for region, _ in page) or not structured(page) and any(region != "furniture" for region, _ in page)


class _Tokens(dict):
    """Hashes of tokens met so far."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return found


_TOKENS = _Tokens()


def prefixes(tokens: list[str]) -> np.ndarray:
    """Hash of the first DEPTH tokens of each suffix that has so many, as signed longs."""
    held, n = np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint64, len(tokens)), max(len(tokens) - DEPTH + 1, 0)
    found = np.zeros(n, np.uint64)
    for k in range(DEPTH):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + held[k : k + n]
    return found.view(np.int64)


def unique_runs(tokens: list[str], covered: np.ndarray) -> list[str]:
    """A block less than half covered whole; of others what is not covered."""
    if 2 * int(covered.sum()) < len(tokens):
        return tokens
    return [w for w, bad in zip(tokens, covered) if not bad]


def _inside(places: np.ndarray | None, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in the first DEPTH of the suffixes at ``places``."""
    edges = np.zeros(size + DEPTH + 1, np.int64)
    if places is not None and len(places):
        starts = np.unique(np.asarray(places, np.int64))
        edges[starts] += 1
        np.subtract.at(edges, starts + DEPTH, 1)
    return np.cumsum(edges)[:size] > 0


def decide(page: list[tuple[str, str]], places: np.ndarray | None = None, most: np.ndarray | None = None) -> str:
    """The article less its hinted blocks that repeats cover by half or more; without one, the open blocks' unique runs.

    ``places`` are the suffixes of the page's stream that begin a repeat,
    ``most`` those that begin one of most pages of the host. Plain blocks of an
    article that these cover whole go, unless they are half of its words or
    more: those of copied articles are no furniture. A page that would have no
    text at all keeps its open blocks.
    """
    has_article = structured(page)
    cut = [text.split() for _, text in page]
    ends = np.cumsum([len(tokens) for tokens in cut], dtype=np.int64)
    size = int(ends[-1]) if len(cut) else 0
    covered, usual = _inside(places, size), _inside(most, size)
    common = [region == "article" and bool(usual[end - len(tokens) : end].all()) for (region, _), tokens, end in zip(page, cut, ends)]
    if 2 * sum(len(tokens) for tokens, bad in zip(cut, common) if bad) >= sum(len(tokens) for (region, _), tokens in zip(page, cut) if region == "article"):
        common = [False] * len(page)
    kept = []
    for (region, text), tokens, end, bad in zip(page, cut, ends, common):
        own = covered[end - len(tokens) : end]
        if region == "article":
            kept += [] if bad else [text]
        elif region == "article?" or region == "open?" and not has_article:
            kept += [text] if 2 * int(own.sum()) < len(tokens) else []
        elif region == "open" and not has_article:
            kept += unique_runs(tokens, own)
    return " ".join(kept) or " ".join(text for region, text in page if region == "open" and not has_article)


def page_text(html: str | None, places: np.ndarray | None = None) -> str:
    return decide(blocks(html or ""), places)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARSED = "page array<struct<region:string,text:string>>, open boolean, content long"


def parse(pages: DataFrame) -> DataFrame:
    """(row, host, k1, k2, page, open, content): one pass over the html.

    ``page`` has the blocks, ``open`` says whether structure leaves something
    to repeats, ``content`` stands for the page's content: copies share it.
    ``row`` has all columns of ``pages`` but html.
    """

    @F.pandas_udf(_PARSED)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            rows = []
            for html in htmls:
                page = blocks(html or "")
                content = xxhash.xxh64_intdigest("\0".join(t for _, t in page).encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.append(([{"region": r, "text": t} for r, t in page], undecided(page), content))
            yield pd.DataFrame(rows, columns=["page", "open", "content"]).astype({"open": bool, "content": "int64"})

    others = [F.col(c) for c in pages.columns if c != "html"]
    row = F.struct(*others) if others else F.struct(F.lit(None).alias("_none"))
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    # one struct column, so that the parser runs once a page
    parsed = pages.select(row.alias("row"), host_of(url.cast("string")).alias("host"), F.xxhash64(url, "html").alias("k1"), F.xxhash64("html", url, F.lit(1)).alias("k2"), cut("html").alias("parsed"))
    return parsed.select("row", "host", "k1", "k2", "parsed.*")


def _stream() -> Column:
    """A page's whole stream, its tokens parted by blanks."""
    return F.array_join("page.text", " ")


def _prefixes(stream: Column) -> Column:
    """The prefixes of a stream, in order."""

    @F.pandas_udf("array<long>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for streams in batches:
            yield pd.Series([prefixes(stream.split()) for stream in streams], dtype=object)

    return cut(stream)


def covered(parsed: DataFrame) -> DataFrame:
    """(k1, k2, places): of every undecided page, the suffixes that begin a repeat of its host."""
    open_hosts = stage_table(parsed.where("open").select("host").distinct(), "hosts")
    near = parsed.join(small(open_hosts), "host", "left_semi")
    counts = near.select("host", "content").distinct().groupBy("host").agg(F.greatest(F.lit(PAGES), F.ceil(SHARE * F.count("*"))).alias("least"))
    spread = near.select("host", "content", F.explode(_prefixes(_stream())).alias("prefix")).distinct().groupBy("host", "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    repeats = spread.join(counts, "host").where(F.col("n") >= F.col("least")).select("host", "prefix")
    repeats = stage_table(repeats, "repeats")
    asked = parsed.where("open").dropDuplicates(["k1", "k2"]).select("host", "k1", "k2", F.posexplode(_prefixes(_stream())).alias("place", "prefix"))
    return asked.join(small(repeats), ["host", "prefix"]).groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))


def _likely(parsed: DataFrame) -> DataFrame:
    """(host, prefix): all prefixes on MOST of a host's pages are among them. Each is on MOST of those pages of the host that some worker counts at once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def found() -> pd.DataFrame:
            hosts, kept = [], [np.zeros(0, np.int64)]
            for host, pages in held.items():
                values, counts = np.unique(np.concatenate(pages), return_counts=True)
                kept.append(values[counts >= MOST * len(pages)])
                hosts += [host] * len(kept[-1])
            held.clear()
            return pd.DataFrame({"host": pd.Series(hosts, dtype=object), "prefix": np.concatenate(kept)})

        for batch in batches:
            for host, stream in zip(batch["host"], batch["stream"]):
                held.setdefault(host, []).append(np.unique(prefixes(stream.split())))
                size += len(held[host][-1])
                if size > COUNTED:
                    size = 0
                    yield found()
        yield found()

    return parsed.select("host", _stream().alias("stream")).mapInPandas(count, "host string, prefix long").distinct()


def usual(parsed: DataFrame) -> DataFrame:
    """(k1, k2, most): the suffixes of each page that begin a repeat of most pages of its host: on MOST of its pages, and of its distinct ones, MOST_PAGES at least."""
    totals = parsed.groupBy("host", "content").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("contents"))
    totals = stage_table(totals.where(F.col("contents") >= MOST_PAGES), "totals")
    large = parsed.join(small(totals.select("host")), "host", "left_semi")
    likely = stage_table(_likely(large), "likely")
    asked = large.select("host", "k1", "k2", "content", F.posexplode(_prefixes(_stream())).alias("place", "prefix")).join(small(likely), ["host", "prefix"])
    # rows that repeat a page have each place as often
    each = stage_table(asked.groupBy("host", "prefix", "content", "k1", "k2").agg(F.collect_set("place").alias("places"), F.count("*").alias("n")), "asked")
    held = each.groupBy("host", "prefix", "content").agg(F.sum(F.col("n") / F.size("places")).alias("n")).groupBy("host", "prefix").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    held = held.join(small(totals), "host").where((F.col("n") >= MOST * F.col("pages")) & (F.col("c") >= F.greatest(F.lit(MOST_PAGES), MOST * F.col("contents"))))
    held = stage_table(held.select("host", "prefix"), "usual")
    return each.join(small(held), ["host", "prefix"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list("places")).alias("most"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, plus ``text`` and ``n_chars``.

    Null, empty and text-free pages give an empty text; a null url is a host
    of its own; repeated rows get equal results; an empty table gives an empty
    result; other columns pass through, but columns named text or n_chars,
    which give way.
    """
    parsed = stage_table(parse(pages), "parsed")
    most = stage_table(usual(parsed), "most")
    rest = parsed.join(small(most), ["k1", "k2"], "left")
    if not parsed.where("open").isEmpty():
        places = stage_table(covered(parsed), "covered")
        rest = rest.join(small(places), ["k1", "k2"], "left")
    else:
        rest = rest.withColumn("places", F.lit(None).cast("array<int>"))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, covers, usuals in batches:
            yield pd.Series([decide([(b["region"], b["text"]) for b in page], cover, common) for page, cover, common in zip(found, covers, usuals)], dtype=object)

    # without a repeat that has a say, a settled page's text is its article's blocks
    asked = F.col("open") | F.col("most").isNotNull()
    plain = F.array_join(F.transform(F.filter("page", lambda b: b["region"] == "article"), lambda b: b["text"]), " ")
    settled = rest.where(~asked).select("row", plain.alias("text")).unionByName(rest.where(asked).select("row", text_of("page", "places", "most").alias("text")))
    own = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("html", "text", "n_chars")]
    return settled.select(*own, "text", F.length("text").cast("long").alias("n_chars"))
