"""HTML extraction: template deduction from equivalence classes of tokens.

Pages of a host are read as tokens: tags (without the values of volatile attributes), words, and
each script, style and comment as a whole.  Tokens with the same occurrence vector over the host's
pages form an equivalence class.  The class of tokens that occur exactly once in the most pages is
the root of the template, in the order most of its pages have; classes with other vectors are
valid if all their occurrences lie in one and the same gap of the root, where they nest.  What is
left of a page in each gap (slot) after removing the template is extracted.

The template is deduced from all pages.  Tokens in fewer than ``SUPPORT`` of a host's pages can't be
part of it, and such a token must be as rare in at least one part of any partition of the pages,
so a first pass keeps, exactly, only tokens that reach that share in some part.  Per-page counts of
these go through map-side combined aggregations, so no task holds a host's pages.

Defined cases: a null or empty page gives no rows; pages without a host in their url are a host of
their own (empty); hosts with fewer than ``LEAST_PAGES`` pages, or without a root, have no template
and their pages are one slot (0) of all their text; repeated rows count as often as they occur; a
null ``page_id`` is reported as null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.spans import Spans, blanks, code_points, hash_text, runs, slices
from mnemora.llm.common import settle, table
from mnemora.llm.textkit import mix

SUPPORT = 0.6
LEAST_PAGES = 4
LEAST_CLASS = 2
#: Pages whose tokens are counted together in the first pass, at least.
_PART = 2_000
#: Tables of one row per host are broadcast up to this many bytes, and joined by shuffling beyond.
BROADCAST_BYTES = 64 << 20

_OPEN = re.compile(r"<!--|<(?:script|style)\b|<[^>]*>", re.I)
_CLOSE = re.compile(r"</(?:script|style)\s*>", re.I)
_VOLATILE = re.compile(r"""\b(href|src|id|content|style|title|alt|value|datetime|data-[\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_LESS = ord("<")


def tag_spans(page: str) -> list[int]:
    """Starts and ends, in turn, of the tags, comments, scripts and styles of a page.

    Every search ends at a closing mark that exists or isn't repeated, so it is linear in any page.
    """
    out: list[int] = []
    at, last = 0, page.rfind(">") + 1  # no tag ends beyond
    comments = scripts = True
    while at < last:
        for m in _OPEN.finditer(page, at, last):
            start, end = m.span()
            if page[end - 1] != ">":
                found = -1
                if page[end - 1] == "-":
                    if comments:
                        found = page.find("-->", end)
                        comments = found >= 0
                    end = found + 3
                elif scripts:
                    close = _CLOSE.search(page, end)
                    scripts = close is not None
                    found = end = close.end() if close else -1
                if found < 0:
                    end = page.find(">", start) + 1
                out += (start, end)
                at = end
                break
            out += (start, end)
        else:
            at = last
    return out


def tokenize(page: str) -> list[str]:
    """Tags, comments, scripts and styles as a whole, and the words between them; a ``<`` that nothing closes is a word."""
    t = Tokens([page])
    return [page[a:b] for a, b in zip(t.starts, t.ends)]


def token_key(token: str) -> int:
    """Signed 64-bit identity of a token; tags lose their volatile values."""
    if token[0] == "<" and len(token) > 1:
        low = token[:8].lower()
        if low.startswith("<!--") and token.endswith("-->"):
            token = "<!-- -->"
        elif low.startswith(("<script", "<style")):
            token = low.split()[0].rstrip(">") + " whole>"
        else:
            token = _SPACE.sub(" ", _VOLATILE.sub(r"\1", token)).lower()
        h = xxhash.xxh64_intdigest(token)
    else:
        h = hash_text(token)
    return h - (1 << 64) if h >> 63 else h


class Tokens(Spans):
    """The tokens of a slice of pages, in order: ``starts``, ``ends``, ``page`` (its index), whether ``tag``, and ``key``."""

    def __init__(self, pages: list[str], known: dict[int, int] | None = None):
        self.text = "\n".join(pages)
        super().__init__(code_points(self.text))
        begin = np.cumsum([0, *(len(p) + 1 for p in pages)])
        found = [tag_spans(p) for p in pages]
        flat = np.array([x for f in found for x in f], np.int64) + np.repeat(begin[:-1], [len(f) for f in found])
        tag_starts, tag_ends = flat[0::2], flat[1::2]
        step = np.zeros(len(self.cps) + 1, np.int8)
        step[tag_starts] += 1
        step[tag_ends] -= 1
        outside = np.cumsum(step, dtype=np.int8)[:-1] == 0
        less = self.cps == _LESS
        word_starts, word_ends = runs(outside & ~less & ~blanks()[self.cps])
        lone = np.flatnonzero(outside & less)
        starts = np.concatenate((word_starts, tag_starts, lone))
        order = np.argsort(starts, kind="stable")
        self.starts = starts[order]
        self.ends = np.concatenate((word_ends, tag_ends, lone + 1))[order]
        self.tag = np.repeat([False, True, False], [len(word_starts), len(tag_starts), len(lone)])[order]
        self.lone = order >= len(word_starts) + len(tag_starts)
        self.page = np.repeat(np.arange(len(pages)), np.diff(np.searchsorted(self.starts, begin)))
        self.key = self.span_hash(self.starts, self.ends).view(np.int64)
        raw, first, back = np.unique(self.key[self.tag], return_index=True, return_inverse=True)
        at = np.flatnonzero(self.tag)[first]
        known = {} if known is None else known
        keys = []
        for k, i, j in zip(raw.tolist(), self.starts[at].tolist(), self.ends[at].tolist()):
            if k not in known:
                new = token_key(self.text[i:j])
                if len(known) >= 200_000:
                    keys.append(new)
                    continue
                known[k] = new
            keys.append(known[k])
        self.key[self.tag] = np.array(keys, np.int64)[back]


def _of_host(host: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a host (by index) and a token."""
    with np.errstate(over="ignore"):
        return mix(key.view(np.uint64) + mix(host.astype(np.uint64) + np.uint64(1)))


def _numbered(hosts: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(number of each host, first row of each, number of each row)."""
    number: dict[str, int] = {}
    first = []
    for i, h in enumerate(hosts):
        if h not in number:
            number[h] = len(number)
            first.append(i)
    return number, np.array(first, np.int64), np.array([number[h] for h in hosts], np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list of values for each of n owners, which are sorted."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _list_at(column: pa.Array, row: int) -> np.ndarray:
    """The values of one row of a list column; none for null."""
    return column.slice(row, 1).flatten().to_numpy(zero_copy_only=False)


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def _frequent(pages: DataFrame, support: float) -> DataFrame:
    """(host, tokens): all tokens that reach the support in some part of the host's pages."""

    def run(batches):
        known, number, size, seen, n = {}, {}, [], [], 0

        def flush():
            names = list(number)
            h, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*seen) if seen else ((), ())))
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]), [True]))) if len(h) else np.zeros(1, np.int64)
            count, h, t = np.diff(edge), h[edge[:-1]], t[edge[:-1]]
            keep = count >= support * np.array(size, np.float64)[h] - 1e-9 if len(h) else np.zeros(0, bool)
            number.clear()
            size.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in h[keep]], pa.string()), pa.array(t[keep], pa.int64())], ["host", "token"])

        for batch in batches:
            hosts, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(htmls):
                tokens = Tokens(htmls[a:b], known)
                for h in hosts[a:b]:
                    if h not in number:
                        number[h] = len(size)
                        size.append(0)
                    size[number[h]] += 1
                _, once = np.unique(_of_host(tokens.page, tokens.key), return_index=True)
                seen.append((np.array([number[h] for h in hosts[a:b]], np.int64)[tokens.page[once]], tokens.key[once]))
                n += b - a
                if n >= _PART:
                    n = 0
                    yield flush()
        yield flush()

    return pages.mapInArrow(run, "host string, token long").groupBy("host").agg(F.collect_set("token").alias("tokens"))


def _with_host_rows(pages: DataFrame, rows: DataFrame, longs: int, how: str = "inner") -> DataFrame:
    """Join a (written) table of one row per host; ``longs`` is its number of long values."""
    return pages.join(F.broadcast(rows) if longs * 16 <= BROADCAST_BYTES else rows, "host", how)


def _occurrences(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per page, its frequent tokens: key, count, and places of the first and last among them."""
    longs = frequent.agg(F.sum(F.size("tokens"))).first()[0] or 0

    def run(batches):
        known = {}
        for batch in batches:
            htmls, every = batch.column(1).to_pylist(), batch.column(0)
            for a, b in slices(htmls):
                tokens, n = Tokens(htmls[a:b], known), b - a
                hosts = every.slice(a, n)
                _, first_row, host = _numbered(hosts.to_pylist())
                wanted = [_list_at(batch.column(2), a + i) for i in first_row]
                wanted = np.sort(_of_host(np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted).astype(np.int64)))
                code = _of_host(host[tokens.page], tokens.key)
                keep = np.zeros(len(code), bool)
                if len(wanted):
                    keep = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
                page, key = tokens.page[keep], tokens.key[keep]
                place = np.arange(len(page)) - np.searchsorted(page, page)
                order = np.lexsort((place, key, page))
                p, k, at = page[order], key[order], place[order]
                edge = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (k[1:] != k[:-1]), [True]))) if len(p) else np.zeros(1, np.int64)
                p, k, first, last, count = p[edge[:-1]], k[edge[:-1]], at[edge[:-1]], at[edge[1:] - 1], np.diff(edge)
                order = np.lexsort((first, p))
                p = p[order]
                columns = [_lists(x[order], p, n, kind) for x, kind in ((k, pa.int64()), (count, pa.int32()), (first, pa.int32()), (last, pa.int32()))]
                yield pa.RecordBatch.from_arrays([hosts.cast(pa.string()), *columns], ["host", "token", "n", "first", "last"])

    joined = _with_host_rows(pages, frequent, longs).select("host", "html", "tokens")
    return joined.mapInArrow(run, "host string, token array<long>, n array<int>, first array<int>, last array<int>")


def deduce(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, root, inner, slot): the ordered root class, and nested tokens with their slots."""
    frequent = settle(_frequent(pages, support))
    per_page = settle(_occurrences(pages, frequent))
    host_n = per_page.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    layout = F.xxhash64("token", "n", "first", "last")
    each = per_page.withColumn("layout", layout).select("host", "layout", F.explode(F.arrays_zip("token", "n")).alias("t"))
    # The occurrence vector is identified by two 31-bit sums over (page, count); equal pages add equal terms.
    term = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "layout", "t.n"), F.lit(1 << 31)))
    vectors = each.groupBy("host", F.col("t.token").alias("token")).agg(F.count("*").alias("n"), term(1).alias("v1"), term(2).alias("v2"), F.max("t.n").alias("most"))
    vectors = vectors.join(host_n, "host").where(F.col("n") >= F.col("pages") * support)
    classes = vectors.groupBy("host", "n", "v1", "v2", "most").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = settle(classes.where(F.size("members") >= LEAST_CLASS))
    root = classes.where("most = 1").groupBy("host").agg(F.max_by("members", F.struct("n", F.size("members"), F.col("members")[0])).alias("root"))
    root = settle(root)
    longs = root.agg(F.sum(F.size("root"))).first()[0] or 0

    def order(batches):
        for batch in batches:
            hosts, out = batch.column("host").to_pylist(), []
            for token, first, r in zip(*(batch.column(c).to_pylist() for c in ("token", "first", "root"))):
                member = set(r)
                out.append([t for _, t in sorted((f, t) for t, f in zip(token, first) if t in member)])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["host", "root"])

    orders = _with_host_rows(per_page.select("host", "token", "first"), root, longs).mapInArrow(order, "host string, root array<long>")
    orders = orders.where(F.size("root") > 0).groupBy("host", "root").count()
    ordered = settle(orders.groupBy("host").agg(F.max_by("root", F.struct("count", "root")).alias("root")))

    def gaps(batches):
        low, high = {}, {}
        for batch in batches:
            for host, token, first, last, r in zip(*(batch.column(c).to_pylist() for c in ("host", "token", "first", "last", "root"))):
                place = dict(zip(token, first))
                at = {t: i for i, t in enumerate(r)}
                ahead = sorted((place[t], at[t]) for t in r if t in place)
                edge = [e for e, _ in ahead]
                for t, f, z in zip(token, first, last):
                    if t not in at:
                        a, b = _gap(edge, ahead, f), _gap(edge, ahead, z)
                        k = (host, t)
                        low[k] = min(low.get(k, a), a)
                        high[k] = max(high.get(k, b), b)
        ks = list(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in ks], pa.string()), pa.array([t for _, t in ks], pa.int64()), pa.array([low[k] for k in ks], pa.int32()), pa.array([high[k] for k in ks], pa.int32())],
            ["host", "token", "low", "high"],
        )

    spread = _with_host_rows(per_page.select("host", "token", "first", "last"), ordered, longs).mapInArrow(gaps, "host string, token long, low int, high int")
    spread = spread.groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    member = classes.withColumn("class", F.xxhash64("n", "v1", "v2", "most")).select("host", "class", F.explode("members").alias("token"))
    nested = member.join(spread, ["host", "token"]).groupBy("host", "class").agg(F.min("low").alias("slot"), F.max("high").alias("high"), F.collect_list("token").alias("members"))
    nested = nested.where("slot = high").select("host", "slot", F.explode("members").alias("token"))
    nested = nested.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "slot"))).alias("x"))
    template = ordered.join(nested, "host", "left")
    return template.select("host", "root", F.coalesce("x.token", F.array().cast("array<long>")).alias("inner"), F.coalesce("x.slot", F.array().cast("array<int>")).alias("slot"))


def _gap(edge: list[int], ahead: list[tuple[int, int]], place: int) -> int:
    """Slot of a place: one more than the index of the last root token before it."""
    i = bisect_left(edge, place)
    return ahead[i - 1][1] + 1 if i else 0


def slots_of(tokens: Tokens, host: np.ndarray, templates: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list, list, list]:
    """(page, slot, text) of the non-empty slots of pages; ``host`` is each page's index in the (root, inner, slot) templates.

    A root token ends the slot before it if none that follows it in the root came earlier.  Text is
    what is neither a tag nor a template token in its place; nested tokens break lines.
    """
    owner = np.repeat(np.arange(len(templates)), [len(t[0]) for t in templates])
    inner_owner = np.repeat(np.arange(len(templates)), [len(t[1]) for t in templates])
    every = lambda i: np.concatenate([t[i] for t in templates]).astype(np.int64) if templates else np.zeros(0, np.int64)
    code = _of_host(host[tokens.page], tokens.key)

    def look_up(owner, key, value):
        known = _of_host(owner, key)
        if not len(known):
            return np.full(len(code), -1, np.int64)
        order = np.argsort(known)
        at = order[np.minimum(np.searchsorted(known, code, sorter=order), len(known) - 1)]
        return np.where(known[at] == code, value[at], -1)

    place = np.concatenate([np.arange(len(t[0])) for t in templates]).astype(np.int64) if templates else np.zeros(0, np.int64)
    root, inner = look_up(owner, every(0), place), look_up(inner_owner, every(1), every(2))
    base = tokens.page * (1 << 32) - 1
    furthest = np.maximum.accumulate(np.maximum(base + root + 1, base)) if len(root) else base
    before = np.maximum(np.concatenate(([-1], furthest[:-1])), base) if len(root) else base
    accepted = (root >= 0) & (base + root + 1 > before)
    slot = furthest - base
    breaks = ~accepted & (inner >= 0) & (inner == slot)
    text = np.flatnonzero(~accepted & ~breaks & ~tokens.tag)
    if not len(text):
        return [], [], []
    lines = np.cumsum(breaks)
    page, slot, lone = tokens.page[text], slot[text], tokens.lone[text]
    new_slot = np.concatenate(([True], (page[1:] != page[:-1]) | (slot[1:] != slot[:-1])))
    new_line = np.concatenate(([False], lines[text][1:] != lines[text][:-1]))
    # Runs of words that nothing divides are taken from the page at once.
    head = new_slot | lone | np.concatenate(([True], (np.diff(text) > 1) | lone[:-1]))
    at = np.flatnonzero(head)
    ends = tokens.ends[text[np.concatenate((at[1:], [len(text)])) - 1]]
    parts: list[str] = []
    texts: list[str] = []
    for first, line, a, b in zip(new_slot[at].tolist(), new_line[at].tolist(), tokens.starts[text[at]].tolist(), ends.tolist()):
        if first and parts:
            texts.append(entities.unescape("".join(parts)))
            parts = []
        if not first:
            parts.append("\n" if line else " ")
        parts.append(" ".join(tokens.text[a:b].split()))
    texts.append(entities.unescape("".join(parts)))
    return page[new_slot].tolist(), slot[new_slot].tolist(), texts


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(page_id, host, slot, text) of every slot that has text."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), "html").where("html is not null and html <> ''")
    template = settle(deduce(source.select("host", "html"), support))
    longs = template.agg(F.sum(F.size("root") + 2 * F.size("inner"))).first()[0] or 0

    def run(batches):
        known = {}
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            for a, b in slices(htmls):
                hosts = batch.column(1).slice(a, b - a)
                _, first_row, host = _numbered(hosts.to_pylist())
                templates = [tuple(_list_at(batch.column(c), a + i).astype(np.int64) for c in (3, 4, 5)) for i in first_row]
                page, slot, text = slots_of(Tokens(htmls[a:b], known), host, templates)
                rows = pa.array(page, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(rows), hosts.take(rows).cast(pa.string()), pa.array(slot, pa.int32()), pa.array(text, pa.string())],
                    ["page_id", "host", "slot", "text"],
                )

    joined = _with_host_rows(source, template, longs, "left").select("page_id", "host", "html", "root", "inner", "slot")
    return joined.mapInArrow(run, "page_id long, host string, slot int, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
