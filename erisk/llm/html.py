"""Main text of pages: element roles, and a host suffix array for what roles leave open.

A page's text is cut into blocks, each with a role: dropped (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments), article (inside an article or main element), or open (neither). The page's candidate text is its article
text, or its open text if it has none.

Host suffix array: the word streams of all blocks of all pages of a host are one text: menus, footers, articles and what stands
open beside an article included. A suffix starts at every word and is sorted by host and its first 12 words. It is filed under the least hash of the 6-word grams in
these words, so equal prefixes are filed under one key, and a page has a quarter as many keys as words. The array is built in two
sorts, for all hosts. First the keys: a batch of pages sorts its own and folds equal neighbours to one, so a menu on every page of
a hot host costs one key a batch; blocks of sorted keys are merged by key range and neighbours compared. Keys of one page alone hold
no suffix that another page has. Then the suffixes of all keys that are left, in whatever blocks, by their words: each batch sorts
its suffixes, folds neighbours of 12 common words to the least and greatest page, and the folded suffixes are sorted by range and
compared with their neighbours once more. Words are compared as they are; hashes only choose what is sorted. Prefixes found on two
different pages are the repeats of the host; roles say which of them are removed, so only these go back to the open texts as word positions. A run of 12 words or more that two pages share is covered by the
repeats that start in it, from its first word to its last; covered words are removed and unique runs are kept. Shorter runs are no
repeats.

Roles are a prior on what a repeat means. In open text every repeat is boilerplate, wherever the other page has it. Article
text stays whole, since an article on two pages, or one that an advert of another page quotes, is still main text (the given
pages have such; README). Unique text of dropped blocks goes by its role, as an advert need not repeat.

Pages are read in time linear in their length, also with tags that never close.

Defined results: null or empty html has an empty text; unclosed and truncated markup is read as far as it goes; a null url
is a host of its own; pages with equal id, url and html count as one page for repeats and get equal texts; no pages, no
rows. Only page_id, url and html are read.
"""
from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import BATCH_ROWS, written

#: Words of a prefix; a suffix starts at every place, so runs of PREFIX + PLACES - 1 words are always found.
PREFIX, PLACES = 12, 1
#: Words of a gram; bits of a key: 10 of them are its bucket, the others fill five bytes with a mark.
GRAM, KEY_BITS = 6, 49
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*+>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*>?|<\Z""", re.S)
#: The same after the last ">": no tag is complete there, and none is looked for.
CUT_OFF = re.compile(r"<!--.*|</?[a-zA-Z][^<]*|<[!?].*|<\Z", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[a-z0-9]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = set("script style textarea title noscript xmp iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
             "sub sup time tt u var wbr img".split())
DROPPED = set("nav header footer aside form menu dialog button select option fieldset script style noscript template head title "
              "textarea iframe object svg canvas audio video".split())
DROPPED_PARTS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr "
                    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav nav "
                    "navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer comment comments "
                    "respond reply replies disqus discussion related recommended share sharing social widget toolbar search form "
                    "copyright disclaimer".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
LANDMARKS = {"article", "main"}
#: Elements that hold the page; their classes describe it and never drop it.
FRAMES = LANDMARKS | {"html", "body"}


def dropped(name: str, tag: str) -> bool:
    if name in DROPPED:
        return True
    if len(tag) < len(name) + 6:
        return False
    for key, value in ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" and name not in FRAMES or key == "aria-hidden" and value == "true" or key == "role" and value in DROPPED_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in FRAMES and any(
                not w.startswith(("has-", "no-", "with-")) and not DROPPED_PARTS.isdisjoint(PART.findall(w)) for w in value.split()):
            return True
        if key in ("class", "id") and name == "article" and not {"comment", "comments", "reply"}.isdisjoint(PART.findall(value)):
            return True
    return False


def texts(page: str) -> tuple[str, str, str]:
    """Article text, open text and dropped text of a page, blocks joined by one space."""
    out: dict[str, list[str]] = {"article": [], "open": [], "dropped": []}
    last_close, open_names = page.rfind(">"), Counter()
    stack: list[tuple[str, bool, bool]] = []          # name, drops, is inside an article
    drop = article = False
    at, end = 0, len(page)

    def say(piece: str) -> None:
        if piece:
            out["dropped" if drop else "article" if article else "open"].append(references.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = (TAG if at <= last_close else CUT_OFF).search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        tag, at = m.group(), m.end()
        found = NAME.match(tag)
        if not found:
            continue
        name = found[1].lower()
        if name not in INLINE:
            for part in out.values():
                part.append(" ")
        if tag[1] == "/":
            while open_names[name]:                       # what is closed is popped once, a stray end tag costs nothing
                popped = stack.pop()[0]
                open_names[popped] -= 1
                if popped == name:
                    drop, article = stack[-1][1:] if stack else (False, False)
                    break
        elif name in RAW and not tag.endswith("/>"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not tag.endswith("/>"):
            drop = drop or dropped(name, tag)
            article = article or name in LANDMARKS or bool(re.search(r"\brole\s*=\s*[\"']?main\b", tag))
            stack.append((name, drop, article))
            open_names[name] += 1
    return tuple(" ".join("".join(part).split()) for part in out.values())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def suffixes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of a word stream and the hashes they are filed under: the least of the grams in their first words."""
    words = text.split()
    if len(words) < PREFIX:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = mixed(np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.uint64) + np.uint64(1))
    n = len(words) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    h, n = mixed(h), len(words) - PREFIX + 1
    return np.arange(n), np.minimum.reduce([h[k:k + n] for k in range(PREFIX - GRAM + 1)]).view(np.int64)


def filed(text: str, host: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of suffixes under one key: their first places, closed by the number of suffixes, and their keys on the host."""
    least = suffixes(text)[1].view(np.uint64)
    first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    return np.append(first, len(least)), mixed(least[first] ^ np.uint64(host % 2 ** 64)) >> np.uint64(64 - KEY_BITS)


def parsed(page: Column) -> Column:
    """Struct: is the candidate text open, the candidate text, and the other texts of the page: its dropped blocks, and on a line of its own
    what stands open beside an article."""
    @F.arrow_udf("struct<open: boolean, text: string, rest: string>")
    def run(pages: pa.Array) -> pa.Array:
        rows = [texts(p or "") for p in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([not a and bool(b) for a, b, _ in rows]), pa.array([a or b for a, b, _ in rows], pa.string()),
                                           pa.array([f"{c}\n{b}" if a and b else c for a, b, c in rows], pa.string())], ["open", "text", "rest"])
    return run(page)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct keys of each batch of pages, cut by bucket; five bytes a key, with a mark: on several pages."""
    for b in batches:
        keys, pages = [], []
        for host, page, text, rest in zip(*(b.column(c).to_pylist() for c in ("host", "page", "text", "rest")), strict=True):
            for stream in (text, *rest.split("\n")):
                own = filed(stream, host)[1]
                keys.append(own)
                pages.append(np.full(len(own), page))
        if not sum(map(len, keys)):
            continue
        key, page = np.concatenate(keys), np.concatenate(pages)
        order = np.argsort(key, kind="stable")
        key, page = key[order], page[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        several = np.minimum.reduceat(page, first) != np.maximum.reduceat(page, first)
        packed = key[first] << np.uint64(1) | several.astype(np.uint64)
        bucket = (packed >> np.uint64(40)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        raw = packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([x.tobytes() for x in np.split(raw, cuts[1:])], pa.binary())], ["bucket", "keys"])


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys on two pages, by the neighbours in the sorted keys of a bucket; rows come sorted by bucket."""
    held, parts = None, []

    def merged() -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
        packed = np.zeros((len(raw), 8), np.uint8)
        packed[:, :5] = raw
        packed = np.sort(packed.view("<u8").ravel())
        key = packed >> np.uint64(1)
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        use = (np.diff(first, append=len(key)) > 1) | (np.bitwise_or.reduceat(packed & np.uint64(1), first) == 1)
        return pa.RecordBatch.from_arrays([pa.array((key[first[use]] | np.uint64(held << 39)).astype(np.int64))], ["key"])

    for b in batches:
        for bucket, keys in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), strict=True):
            if parts and bucket != held:
                yield merged()
                parts = []
            held = bucket
            parts.append(keys)
    if parts:
        yield merged()


def runs(text: Column, host: Column) -> Column:
    """Each run of suffixes under one key: the key, the first place and the words of all its suffixes' prefixes."""
    @F.arrow_udf("array<struct<key: bigint, at: int, words: string>>")
    def run(column: pa.Array, hosts: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(column.to_pylist(), hosts.to_pylist(), strict=True):
            found = []
            for stream in t.split("\n"):
                (first, keys), words = filed(stream, h), stream.split()
                found += [{"key": k, "at": a, "words": " ".join(words[a:b + PREFIX - 1])} for k, a, b in zip(keys.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("words", pa.string())])))
    return run(text, host)


def common_words(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


def folded(entries: Iterator[tuple[int, list[str], int, int, bool]]) -> Iterator[tuple[int, list[str], int, int, bool]]:
    """Sorted suffixes (host, words, least page, greatest page, open), neighbours of PREFIX common words as one."""
    held = None
    for e in entries:
        if held and held[0] == e[0] and common_words(held[1], e[1]) >= PREFIX:
            held = held[0], held[1], min(held[2], e[2]), max(held[3], e[3]), held[4] or e[4]
            continue
        if held:
            yield held
        held = e
    if held:
        yield held


ENTRIES = "host bigint, prefix string, a bigint, b bigint, open boolean"
ENTRY = pa.schema([("host", pa.int64()), ("prefix", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])


def packed_entries(found: list[tuple[int, list[str], int, int, bool]]) -> pa.RecordBatch:
    columns = list(zip(*((h, " ".join(w), a, b, o) for h, w, a, b, o in found), strict=True)) or [[]] * len(ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)


def local_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix array of each batch of runs, folded."""
    for b in batches:
        found = []
        for host, page, is_open, text in zip(*(b.column(c).to_pylist() for c in ("host", "page", "open", "words")), strict=True):
            words = text.split(" ")
            found += [(host, words[k:k + PREFIX], page, page, is_open) for k in range(len(words) - PREFIX + 1)]
        yield packed_entries(list(folded(sorted(found))))


def merged_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by host and words, folded over the whole range that a task reads."""
    rows = ((h, p.split(" "), a, b, o) for x in batches for h, p, a, b, o in zip(*(x.column(c).to_pylist() for c in ENTRY.names), strict=True))
    found = folded(rows)
    while part := list(islice(found, BATCH_ROWS)):
        yield packed_entries(part)


def unique_runs(text: str, covered: list[int] | None) -> str:
    """The words that no repeated run covers."""
    if not covered:
        return text
    words = text.split(" ")
    keep = np.ones(len(words), bool)
    for a in covered:
        keep[a:a + PREFIX] = False
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def own_text(text: Column, covered: Column) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array, covers: pa.Array) -> pa.Array:
        return pa.array([unique_runs(t, c) for t, c in zip(column.to_pylist(), covers.to_pylist(), strict=True)], pa.string())
    return run(text, covered)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.xxhash64("page_id", "url", "html").alias("page"),
                       parsed(F.col("html")).alias("p"))
    streams = written(own.select("page_id", "url", "page", F.xxhash64(host_of(F.col("url"))).alias("host"), "p.*"), "streams")
    keys = streams.select("host", "page", "text", "rest").mapInArrow(blocks, "bucket int, keys binary")
    shared = written(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_keys, "key bigint"), "shared")
    both = [streams.select("page", "host", flag.alias("open"), F.explode(runs(F.col(text), F.col("host"))).alias("r"))
            for text, flag in (("text", F.col("open")), ("rest", F.lit(False)))]
    near = both[0].unionByName(both[1]).select("page", "host", "open", "r.*")
    near = written(near.join(shared, "key", "left_semi").select("page", "host", "open", "at", "words"), "near")
    local = written(near.mapInArrow(local_arrays, ENTRIES), "local")
    array = local.repartitionByRange("host", "prefix").sortWithinPartitions("host", "prefix").mapInArrow(merged_arrays, ENTRIES)
    repeats = written(array.filter("a <> b"), "repeats")                # of all blocks; those of open text are removed
    words = F.split("words", " ")
    places = F.explode(F.sequence(F.lit(0), F.size(words) - PREFIX)).alias("k")
    opens = near.filter("open").select("page", "host", "at", words.alias("w"), places)
    marks = opens.select("page", "host", (F.col("at") + F.col("k")).alias("at"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(PREFIX)), " ").alias("prefix"))
    marks = marks.join(repeats.filter("open").select("host", "prefix"), ["host", "prefix"], "left_semi")
    covers = written(marks.groupBy("page").agg(F.array_sort(F.collect_set("at")).alias("covered")), "covers")
    opened = streams.filter("open").join(covers, "page", "left").select("page_id", "url", own_text(F.col("text"), F.col("covered")).alias("text"))
    return streams.filter("not open").select("page_id", "url", "text").unionByName(opened).withColumn("n_chars", F.length("text").cast("bigint"))
