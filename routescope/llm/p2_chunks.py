"""Problem 2: cutting long texts into overlapping pieces at natural places.

Content-defined chunking. A rolling hash over the last 32 characters marks landmarks that depend only on the
text around them. From the start of a piece the first landmark past the minimum size is taken and snapped to
the nearest natural boundary in reach: a paragraph or sentence end, else a word end. An edit therefore moves
only the cuts next to it; behind it the cuts fall on the same landmarks again. Without a natural boundary in
the whole reach of ``max_chars`` the cut is forced. Each piece but the first repeats up to ``overlap``
characters before its cut, less where the piece would pass ``max_chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routescope.sources.tables import table

MAX_CHARS, MIN_CHARS, OVERLAP = 2000, 600, 200
LANDMARK_EVERY = 256
WINDOW = 32

# The marks at which a text may be cut (TESTDATA.md, p2_found), and closing quotes and brackets.
ENDS = ".!?。！？।؟۔።"
CLOSERS = "\"'”’»)]}」』）】›“"
_ENDS = np.array([ord(c) for c in ENDS], np.uint32)
_CLOSERS = np.array([ord(c) for c in CLOSERS], np.uint32)
_SPACE_SET = frozenset(c for c in range(0x3001) if chr(c).isspace())
_SPACES = np.array(sorted(_SPACE_SET), np.uint32)


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions p such that the characters before p end in a landmark."""
    g = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    h = np.zeros(len(g), np.uint64)
    for j in range(min(WINDOW, len(g))):
        h[j:] += g[: len(g) - j] << np.uint64(j)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(LANDMARK_EVERY) == 0) + 1


def _boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence and paragraph ends, all natural cut positions), ascending, strictly inside the text."""
    n = len(codes)
    space, end, closer = np.isin(codes, _SPACES), np.isin(codes, _ENDS), np.isin(codes, _CLOSERS)
    soft = space | end
    any_at = np.flatnonzero(soft[:-1] | soft[1:]) + 1 if n > 1 else np.empty(0, np.int64)
    # A sentence end: a mark, closers after it, then the first non-space; or a wide mark without a space.
    idx = np.arange(n)
    word = ~space & ~closer
    last_word = np.maximum.accumulate(np.where(word, idx, -1))
    ended = np.zeros(n, bool)
    ended[1:] = (last_word[:-1] >= 0) & end[np.maximum(last_word[:-1], 0)]
    gap_space = np.zeros(n, bool)
    gap_space[1:] = space[:-1]
    wide = np.zeros(n, bool)
    wide[1:] = (last_word[:-1] >= 0) & (codes[np.maximum(last_word[:-1], 0)] > 0x2000) & end[np.maximum(last_word[:-1], 0)]
    line = codes == 10
    paragraph = np.zeros(n, bool)
    paragraph[2:] = line[1:-1] & (line[:-2] | (codes[:-2] == 13))
    strong = ((ended & (gap_space | wide)) | paragraph) & ~space & ~closer
    strong[0] = False
    return np.flatnonzero(strong), any_at


def _nearest(at: np.ndarray, low: int, high: int, to: int) -> int | None:
    """The entry of ``at`` in (low, high] nearest to ``to``."""
    a, b = np.searchsorted(at, low, "right"), np.searchsorted(at, high, "right")
    if a >= b:
        return None
    i = int(np.searchsorted(at[a:b], to)) + a
    best = [int(at[k]) for k in (i - 1, i) if a <= k < b]
    return min(best, key=lambda p: (abs(p - to), p))


def split(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces (start with overlap, cut before, cut after, kind of the cut after) of a text; kind: natural, forced, end."""
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n, "end")] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = landmarks(codes)
    strong, weak = _boundaries(codes)
    out, s = [], 0
    while n - s > max_chars:
        low, high, top = s + min_chars, s + max_chars - overlap, s + max_chars
        i = int(np.searchsorted(marks, low, "right"))
        want = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut, kind = _nearest(strong, low, high, want), "natural"
        if cut is None:
            cut = _nearest(weak, low, high, want)
        if cut is None:
            cut = _nearest(weak, high, top, high)
        if cut is None:
            cut = _nearest(weak, s, low, low)
        if cut is None:
            cut, kind = want, "forced"
        out.append((s, cut, kind))
        s = cut
    out.append((s, n, "end"))

    def opening(s: int, end: int) -> int:
        """Where the piece with new text s..end starts: a word start up to ``overlap`` characters before s."""
        reach = max(0, s - overlap, end - max_chars)
        j = int(np.searchsorted(weak, reach))
        while j < len(weak) and weak[j] < s and codes[weak[j]] in _SPACE_SET:
            j += 1
        return int(weak[j]) if j < len(weak) and weak[j] < s else reach

    return [(opening(s, end) if s else 0, s, end, kind) for s, end, kind in out]


def _split_batches(max_chars: int, min_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text.strip()
                if len(text) <= max_chars:
                    continue
                for i, (a, b, c, kind) in enumerate(split(text, max_chars, min_chars, overlap)):
                    rows.append((key, i, a, c, b - a, kind, text[a:c]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["id", "piece", "start_char", "end_char", "overlap", "cut", "text"]
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def chunks(df: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text above ``max_chars`` characters (code points) after removing white space at both ends.

    ``df``: id, text. Returns id, piece (from 0), start_char and end_char (in the stripped text), overlap (the
    characters repeated from the piece before), cut (how the piece ends: natural, forced, or end for the last) and
    text. Null, empty and shorter texts give no rows, nor do null ids' texts lose any: a null id is kept as it is.
    Repeated rows are cut again; an empty table gives no rows; extra columns are ignored.
    """
    if not 0 <= overlap < max_chars or not 0 < min_chars < max_chars - overlap:
        raise ValueError("0 < min_chars < max_chars - overlap must hold")
    long = df.select("id", "text").where(F.length("text") > max_chars)
    return long.mapInArrow(_split_batches(max_chars, min_chars, overlap), "id string, piece int, start_char int, end_char int, overlap int, cut string, text string")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each text once: of rows delivered again the latest. What is too short travels without its text."""
    long = F.length("text") > MAX_CHARS
    rows = table(spark, folder, "records").where("text_id is not null").select("text_id", "loaded_at", F.when(long, F.col("text")).alias("text"))
    w = Window.partitionBy("text_id").orderBy(F.desc_nulls_last("loaded_at"), F.xxhash64("text"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1 and text is not null").select(F.col("text_id").alias("id"), "text")


def p2_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every long text."""
    return chunks(_texts(spark, folder)).withColumnRenamed("id", "text_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    forced = F.max(F.col("cut") == "forced")
    return p2_chunks(spark, folder).groupBy("text_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))


QUERIES = {"p2_chunks": p2_chunks, "p2_found": p2_found}

ORACLE = {
    "p2_found": r"""
with t as (select text_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from (
  select *, row_number() over (partition by text_id order by loaded_at desc nulls last) as rk from records where text_id is not null) where rk = 1 and length(text) > 2000)
select text_id, case when list_max(list_transform(regexp_split_to_array(text, '[\s.!?。！？।؟۔።]'), lambda x: length(x))) > 2000
  then 'forced' else 'natural' end as cut from t where length(text) > 2000
""",
}
