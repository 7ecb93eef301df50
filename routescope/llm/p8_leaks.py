"""Problem 8: evaluation passages leaking into training text.

Q-gram lemma filtering. Documents and items are reduced to streams of folded letters and digits (markup, entities,
typography, accents, case, punctuation and layout removed), with the word borders kept aside. Of a document every
``step``-th q-gram is looked up among the items' q-grams. By the q-gram lemma a window of m characters with at most
``edits`` edits shares at least (m - q + 1) div step - edits * ceil(q / step) of those samples with its copy, so
stretches of the document with fewer hits than any item's window requires are left at once. The hits that remain lie
on diagonals (document position minus item position) and are counted in overlapping diagonal bands; a band with
fewer hits than its item requires is dropped. The rest is verified by banded alignment within the edit budget: a
passage counts if ``words`` consecutive item words (of Chinese items: ``han`` characters) align with at most
``edits`` inserted, deleted or replaced characters. The budget is 0 for a leak as TESTDATA.md defines it.

Scale: texts are folded and searched a batch at a time in arrays, without a shuffle. The item table goes to every
task, in blocks of at most ``block_chars`` characters. A larger item set takes several blocks: then one pass folds
the documents and writes the few whose stretches of hits, in a bit table over all items' q-grams, are long enough;
only these are matched with every block, so the corpus is read and folded once however many items there are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.session import cut_lineage
from routescope.sources.tables import table

WORDS, HAN = 12, 20
Q, STEP = 6, 3
EDITS = 0
BAND, OVERLAP = 12, 4
BLOCK_CHARS = 4_000_000
ALIGN_CELLS = 4_000_000
SLICE_CHARS = 2_000_000
TABLE_BITS = 26

# A tag of any length by the grammar of attributes, or one whose quotes are broken; "a <b and, as said, c> d" is text.
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:@-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)*\s*/?>|</?[A-Za-z][\w:-]*\s[^<>]{0,300}=["'][^<>]{0,300}>""")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t]*(?=\w)")
# Letters that no Unicode decomposition takes apart.
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})

BORDER, HYPHEN, BLANK, LINE, END = range(5)  # what separates words; letters and digits have codes of LETTER and above
LETTER, GONE = 48, 0xFFFFFFFF
_CODES = 0x110000


class Folding:
    """Code point -> folded code points, filled in as characters turn up."""

    def __init__(self):
        self.first = np.zeros(_CODES, np.uint32)
        self.known = np.zeros(_CODES, bool)
        self.more: dict[int, list[int]] = {}
        self.long = np.zeros(_CODES, bool)

    def _learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            ch = chr(c)
            plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold()).translate(_PLAIN)
            out = []
            for x in plain:
                if unicodedata.category(x) in ("Mn", "Me", "Cf"):
                    continue
                out.append(ord(x) if x.isalnum() else HYPHEN if x in "-‐‑" else BLANK if x in " \t\r" else LINE if x == "\n" else END if x == "\0" else BORDER)
            self.first[c] = out[0] if out else GONE
            if len(out) > 1:
                self.more[c], self.long[c] = out, True
        self.known[codes] = True

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        known = self.known[codes]
        if not known.all():
            self._learn(np.unique(codes[~known]))
        out = self.first[codes]
        long = np.flatnonzero(self.long[codes])
        if len(long):
            parts = [self.more[c] for c in codes[long].tolist()]
            size = np.ones(len(codes), np.int64)
            size[long] = [len(p) for p in parts]
            at = np.cumsum(size) - size
            out = np.repeat(out, size)
            where = np.repeat(at[long], size[long]) + np.concatenate([np.arange(len(p)) for p in parts])
            out[where] = np.concatenate(parts)
        return out[out != GONE]


_fold = Folding()


def unmarked(text: str) -> str:
    """Without entities and markup; a tag leaves a space, so a word may begin or end at it."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        if "<!--" in text:
            cut = text.rfind("-->") + 3
            text = _COMMENT.sub(" ", text[:cut]) + text[cut:]
        text = _TAG.sub(" ", text)
    return text


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits of the folded texts end to end, where each text's begin (with the end), and whether a word
    begins at each of them (with the end)."""
    joined = "\0".join([unmarked(t).replace("\0", " ") if "&" in t or "<" in t or "\0" in t else t for t in texts] + [""])
    f = _fold(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    at = np.flatnonzero(f >= LETTER)
    start = np.concatenate(([0], np.searchsorted(at, np.flatnonzero(f == END))))
    border = np.ones(len(at) + 1, bool)
    border[1:-1] = np.diff(at) > 1
    # A word broken by a hyphen at the end of a line goes on in the next.
    p = np.flatnonzero(f == HYPHEN)
    p = p[(p > 0) & (f[p - 1] >= LETTER)] + 1
    for skip, once in ((BLANK, False), (LINE, True), (BLANK, False)):
        if once:
            p = p[(p < len(f)) & (f[np.minimum(p, len(f) - 1)] == skip)] + 1
        else:
            p = p[p < len(f)]
            while (more := f[np.minimum(p, len(f) - 1)] == skip).any():
                p = p + more
    p = p[p < len(f)]
    border[np.searchsorted(at, p[f[p] >= LETTER])] = False
    border[start] = True
    return f[at], start, border


def is_han(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0x3400) & (codes <= 0x9FFF) | (codes >= 0x20000) & (codes <= 0x3FFFF) | (codes >= 0xF900) & (codes <= 0xFAFF)


def qgrams(codes: np.ndarray, q: int = Q, step: int = 1) -> np.ndarray:
    """Hashes of the q-grams that begin at every ``step``-th character."""
    n = (len(codes) - q) // step + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x100000001B3) + codes[j : j + (n - 1) * step + 1 : step].astype(np.uint64)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def units_of(text: str, words: int, han: int) -> tuple[np.ndarray, np.ndarray, int, bool] | None:
    """An item's stream, where its units begin (with the end), how many make a passage, and whether they are characters."""
    pieces = _BROKEN.sub("", unmarked(text)).split()
    codes, start, _ = streams(pieces) if pieces else (np.empty(0, np.uint32), np.zeros(1, np.int64), None)
    if not len(codes):
        return None
    by_char = 2 * int(is_han(codes).sum()) > len(codes)
    units = np.arange(len(codes) + 1) if by_char else np.unique(start)
    need = han if by_char else words
    return (codes, units, need, by_char) if len(units) > need else None


def shortest(units: np.ndarray, need: int) -> int:
    return int((units[need:] - units[:-need]).min())


def sampling(least: int | None, edits: int) -> tuple[int, int]:
    """(q, step) for passages of at least ``least`` characters, so that the lemma requires a hit at least."""
    if edits > OVERLAP:
        raise ValueError("the edit budget exceeds the overlap of the bands")
    for q in range(Q, 0, -1):
        for step in range(min(STEP, q), 0, -1):
            if least is None or required(least, q, step, edits) > 0:
                return q, step
    raise ValueError("the edit budget is as large as a passage")


def required(chars: int, q: int, step: int, edits: int) -> int:
    return (chars - q + 1) // step - edits * -(-q // step)


class Items:
    """A block of items: streams, units, q-gram table and the hits each item requires."""

    def __init__(self, rows: list[tuple[int, str]], words: int = WORDS, han: int = HAN, edits: int = EDITS, least: int | None = None):
        self.ids, self.codes, self.units, self.need, self.by_char, self.edits = [], [], [], [], [], edits
        for item, text in rows:
            found = units_of(text, words, han)
            if found is not None:
                for held, value in zip((self.ids, self.codes, self.units, self.need, self.by_char), (item, *found), strict=True):
                    held.append(value)
        windows = [shortest(u, n) for u, n in zip(self.units, self.need, strict=True)]
        self.q, self.step = sampling(min(windows, default=None) if least is None else least, edits)
        self.least = np.array([required(w, self.q, self.step, edits) for w in windows], np.int64)
        self.span = np.array([(w - self.q + 1) // self.step for w in windows], np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        grams = [qgrams(c, self.q) for c in self.codes]
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        gram = cat(grams, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, np.int64)
        at = cat([np.arange(len(g)) for g in grams], np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.at = owner[order], at[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        # Character and word items require runs of different lengths: a class of items each, with its own q-grams.
        self.kinds = []
        for kind in (False, True):
            mine = np.flatnonzero(np.array(self.by_char, bool) == kind)
            if len(mine):
                has = np.zeros(len(self.gram), bool)
                has[np.repeat(np.arange(len(self.gram)), self.count)[np.isin(self.owner, mine)]] = True
                self.kinds.append((has, *loosest(self.span[mine], self.least[mine])))
        self.bits = bit_table([self.gram])


def loosest(span: np.ndarray, least: np.ndarray) -> tuple[int, int]:
    """(samples, hits): any item's window has a stretch of so many samples with so many hits."""
    k = int(np.argmin(least))
    return int(span[k]), int(least[k])


def bit_table(grams: list[np.ndarray]) -> np.ndarray:
    """One bit per value of the first TABLE_BITS bits of a hash, whatever the number of q-grams."""
    bits = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    for g in grams:
        top = g >> np.uint64(64 - TABLE_BITS)
        np.bitwise_or.at(bits, (top >> np.uint64(3)).astype(np.int64), np.uint8(1) << (top & np.uint64(7)).astype(np.uint8))
    return bits


def in_table(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    top = g >> np.uint64(64 - TABLE_BITS)
    return (bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def dense(hit: np.ndarray, span: int, least: int) -> np.ndarray:
    """The hits that lie in a stretch of ``span`` samples with ``least`` hits."""
    if len(hit) < span:
        return np.zeros(len(hit), bool)
    total = np.concatenate(([0], np.cumsum(hit)))
    full = total[span:] - total[:-span] >= least
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(full), 1)
    np.add.at(cover, np.flatnonzero(full) + span, -1)
    return hit & (np.cumsum(cover[:-1]) > 0)


def candidates(items: Items, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, band) with enough hits. codes: documents' streams end to end; start: where they begin, and the end."""
    none = np.empty(0, np.int64)
    g = qgrams(codes, items.q, items.step)
    if not len(g) or not len(items.gram):
        return none, none, none
    some = np.flatnonzero(in_table(items.bits, g))
    slot = np.minimum(np.searchsorted(items.gram, g[some]), len(items.gram) - 1)
    there = items.gram[slot] == g[some]
    some, slot = some[there], slot[there]
    keep = np.zeros(len(g), bool)
    for has, span, least in items.kinds:
        hit = np.zeros(len(g), bool)
        hit[some[has[slot]]] = True
        keep |= dense(hit, span, least)
    kept = keep[some]
    pos, slot = some[kept] * items.step, slot[kept]
    d = np.searchsorted(start, pos, side="right") - 1
    inside = pos + items.q <= start[d + 1]
    pos, slot, d = pos[inside], slot[inside], d[inside]
    if not len(pos):
        return none, none, none
    n = items.count[slot]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first[slot], n)
    pos, d = np.repeat(pos, n), np.repeat(d, n)
    item, at = items.owner[entry], items.at[entry]
    diagonal = pos - start[d] - at + items.length[item]  # never negative
    band = diagonal // BAND
    low = (diagonal % BAND < OVERLAP) & (band > 0)  # these lie in the band below as well
    d, item, band, pos = (np.concatenate((x, x[low] - y)) for x, y in ((d, 0), (item, 0), (band, 1), (pos, 0)))
    order = np.lexsort((pos, band, item, d))
    d, item, band, pos = d[order], item[order], band[order], pos[order]
    fresh = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)))
    counted = fresh | np.concatenate(([True], np.diff(pos) != 0))  # a sample counts once a band
    starts = np.flatnonzero(fresh)
    hits = np.add.reduceat(counted.astype(np.int64), starts)
    ok = hits >= items.least[item[starts]]
    return d[starts][ok], item[starts][ok], band[starts][ok]


def align(item: np.ndarray, text: np.ndarray, units: np.ndarray, need: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignment of item codes [L] with the documents' bands text [n, L + width].

    From each unit on each diagonal of the band the alignment runs along equal characters, and may ``edits`` times
    pass a differing one, skip one of the text or one of the item (furthest reach by diagonal and number of edits).
    Returns (row, diagonal, last diagonal, first unit) of every passage of ``need`` units.
    """
    n, length = text.shape[0], len(item)
    width = text.shape[1] - length
    first, behind = units[:-need], units[need:]
    # the next differing position at or behind each position, by diagonal
    reach = np.full((width, n, length + 1), length, np.int32)
    for k in range(width):
        differs = np.where(text[:, k : k + length] != item[None, :], np.arange(length, dtype=np.int32), length)
        reach[k, :, :length] = np.minimum.accumulate(differs[:, ::-1], axis=1)[:, ::-1]
    found = []
    for k in range(width):
        far = {0: reach[k][:, first]}
        for _ in range(edits):
            grown = {}
            for o in range(-edits, edits + 1):
                if not 0 <= k + o < width:
                    continue
                options = [far[o + s] + more for s, more in ((0, 1), (-1, 0), (1, 1)) if o + s in far]
                if options:
                    at = np.minimum(np.maximum.reduce(options), length)
                    grown[o] = np.maximum(np.take_along_axis(reach[k + o], at, 1), far.get(o, 0))
            far = grown
        for o, at in far.items():
            row, unit = np.nonzero(at >= behind)
            found.append((row, np.full(len(row), k), np.full(len(row), k + o), unit))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaks(items: Items, codes: np.ndarray, start: np.ndarray, border: np.ndarray) -> list[tuple[int, int]]:
    """(document index, item index) of every leak among the documents; arguments as :func:`streams` returns them."""
    d, item, band = candidates(items, codes, start)
    found: set[tuple[int, int]] = set()
    order = np.lexsort((band, d, item))
    d, item, band = d[order], item[order], band[order]
    width = BAND + OVERLAP
    for k in np.unique(item):
        mine = np.flatnonzero(item == k)
        length = int(items.length[k])
        units, need = items.units[k], items.need[k]
        chunk = max(1, ALIGN_CELLS // (length * width))
        for a in range(0, len(mine), chunk):
            rows = mine[a : a + chunk]
            base = start[d[rows]] + band[rows] * BAND - length  # the document position of the item's first character
            at = base[:, None] + np.arange(length + width)[None, :]
            inside = (at >= start[d[rows]][:, None]) & (at < start[d[rows] + 1][:, None])
            text = np.where(inside, codes[np.clip(at, 0, max(len(codes) - 1, 0))], 0)
            row, diagonal, last, unit = align(items.codes[k], text, units, need, items.edits)
            opens, closes = base[row] + diagonal + units[unit], base[row] + last + units[unit + need]
            # words of the passage must be whole words of the document, Chinese characters are units of their own
            fits = np.ones(len(row), bool) if items.by_char[k] else border[np.clip(opens, 0, len(codes))] & border[np.clip(closes, 0, len(codes))]
            found |= {(x, int(k)) for x in np.unique(d[rows[row[fits]]]).tolist()}
    return sorted(found)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of about SLICE_CHARS characters at a time; bounds the arrays held."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        step = np.cumsum([len(t) for t in texts]) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.column("doc_id").slice(a, b - a), texts[a:b]


def _pairs(items: Items, ids: list[int], codes: np.ndarray, start: np.ndarray, border: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = leaks(items, codes, start, border)
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in pairs], pa.int64()), pa.array([items.ids[k] for _, k in pairs], pa.int64())], names=["doc_id", "item_id"])


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            yield from _pairs(items, ids.to_pylist(), *streams(texts))

    return run


def _suspects(bits: np.ndarray, q: int, step: int, span: int, least: int):
    """The folded documents that have a stretch of hits in the table of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            codes, start, border = streams(texts)
            hit = dense(in_table(bits, qgrams(codes, q, step)), span, least)
            rows = np.unique(np.searchsorted(start, np.flatnonzero(hit) * step, side="right") - 1)
            stream = [codes[start[r] : start[r + 1]].tobytes() for r in rows]
            words = [np.packbits(border[start[r] : start[r + 1]]).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(stream, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "stream", "words"])

    return run


def _match(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                parts = [np.frombuffer(x, np.uint32) for x in part.column("stream").to_pylist()]
                words = [np.unpackbits(np.frombuffer(w, np.uint8), count=len(x)).astype(bool) for w, x in zip(part.column("words").to_pylist(), parts, strict=True)]
                yield from _pairs(items, part.column("doc_id").to_pylist(), np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.concatenate([*words, [True]]))

    return run


def _windows(words: int, han: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = filter(None, (units_of(t, words, han) for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([shortest(u, need) for _, u, need, _ in found], pa.int32())], names=["window"])

    return run


def contaminated(docs: DataFrame, evals: DataFrame, words: int = WORDS, han: int = HAN, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (doc_id, item_id) where the document contains ``words`` consecutive words of the item.

    ``docs``: doc_id, text; ``evals``: item_id, text. ``edits`` (up to OVERLAP) is the number of characters that a
    passage may differ in. Null texts and null ids contain and leak nothing; items of fewer words (Chinese:
    characters) than required leak nothing; an empty table gives no rows; repeated rows give one row; extra columns,
    also of equal names, are ignored. Very long documents are searched whole, tags of any length are markup.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    evals = evals.select("item_id", "text").where("item_id is not null and text is not null")
    total = evals.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))

    def block(b: int, least: int | None = None) -> Items:
        rows = evals.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_chars characters
        return Items([(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"], r["text"]))], words, han, edits, least)

    if blocks == 1:
        return docs.mapInArrow(_scan(block(0)), "doc_id bigint, item_id bigint").distinct()
    least = evals.mapInArrow(_windows(words, han), "window int").agg(F.min("window")).first()[0]
    q, step = sampling(least, edits)
    bits = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    for b in range(blocks):
        bits |= block(b, least).bits
    span, hits = ((least - q + 1) // step, required(least, q, step, edits)) if least is not None else (1, 1)
    folded = cut_lineage(docs.mapInArrow(_suspects(bits, q, step, span, hits), "doc_id bigint, stream binary, words binary"))
    out = None
    for b in range(blocks):
        part = cut_lineage(folded.mapInArrow(_match(block(b, least)), "doc_id bigint, item_id bigint").distinct())
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked item with the number of documents it leaked into."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLE: dict[str, str] = {}
