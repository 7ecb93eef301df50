"""Problem 9: sentence boundaries across languages and scripts.

A linear-chain sequence model tags characters as boundary or inside. Only characters that can end a sentence carry
a choice: end marks (with the closing quotes and brackets behind them), white space in scripts written without
spaces between words, blank lines and the end of the text; all others are inside. Each choice has features of its
surroundings, neighbouring choices are linked by transition weights, and Viterbi decoding finds the best tagging of
a text. The weights are those of an averaged structured perceptron, fitted on the labelled text of
``sentence_examples``; for scripts without end marks it is fitted on punctuation-stripped text: wide-script examples
whose marks are replaced by spaces, with numbers set off by spaces, so it must learn which spaces were marks.

There is no list of abbreviations. Which words go before a mark that ends nothing is learned twice: from the labelled
text (the words seen before such marks, each with weights of its own), and without labels from the documents to be cut:
a word that mostly has a mark behind it and often a small letter after that mark is an abbreviation of this corpus.
These counts cover all documents; a word is kept if it makes at least ``share`` of all words before marks, so at most
1 / share of them are ever sent to the tasks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.llm.sentence_examples import EXAMPLES
from routescope.session import cut_lineage
from routescope.sources.tables import table

EPOCHS = 40
MARGIN = 4.0
TRANSITION_RATE = 0.1
TOKEN_CHARS = 40  # a longer one is no abbreviation
SHARE = 1e-5
LEAST_SEEN = 3

# End marks, quotes and brackets.
MARKS = ".!?…。！？；؟۔।።;"
OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
CLOSE = set("”»」』)）]")
BRACKETS = set("()（）[]")
_UNSPACED = "฀-໿က-႟ក-៿"
_STEP = re.compile(rf"(?P<para>\r?\n[^\S\n]*\n\s*)|(?P<mark>[{re.escape(MARKS)}]+)|(?P<open>[“„«「『(（\[])|(?P<close>[”»」』)）\]])|(?P<gap>(?<=[{_UNSPACED}])\s+(?=\S)(?!\n[^\S\n]*\n))")
_STRIPPED_GAP = re.compile(r"\s+(?=\S)")
_OPENING = re.compile(r"[(«„“（「\[]")
_LAST_WORD = re.compile(r"(\w*)\s*$")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_SPACE = re.compile(r"\s*")


def _kind(text: str, j: int) -> str:
    """What begins at position j behind a mark and its white space."""
    c = text[j]
    if c.isdigit():
        return "digit"
    if c.isalpha():
        if c.isupper():
            return "upper"
        if c.islower():
            word = text[j + 1 : j + 12].split(maxsplit=1)
            return "symbol" if word and not text[j + 1].isspace() and any(x.isupper() or x.isdigit() for x in word[0]) else "lower"
        return "wide" if "⺀" < c < "꓏" or "가" < c < "힣" else "letter"
    if c in OPEN or c in "¿¡‘'\"":
        return "open"
    if c in "—–-":
        return "dash"
    if c in ",;:，：、":
        return "comma"
    return "other"


def _token(before: str) -> str:
    """What stands before a mark, back to white space or an opening quote or bracket."""
    if not before or before[-1].isspace():
        return ""
    return _OPENING.split(before.rsplit(None, 1)[-1])[-1]


@lru_cache(maxsize=65536)
def _word(token: str) -> str:
    """The word before a mark as it is counted: small letters, with inner marks, without a sentence before it that has no
    space behind its mark; empty if it is a number or holds anything else."""
    head, _, tail = token.rpartition(".")
    if len(head) > 2 and head[-3:].isalpha():
        token = tail
    low = token.lower()
    return low if 1 < len(low) <= 12 and all(x.isalpha() or x in ".-" for x in low) and not low.startswith((".", "-")) else ""


@lru_cache(maxsize=65536)
def _shape(token: str) -> str:
    if not token:
        return "none"
    head, _, tail = token.rpartition(".")
    if len(head) > 2 and head[-3:].isalpha():
        token = tail
    if not token:
        return "none"
    if len(token) == 1 and token.isalpha():
        return "initial" if token.isupper() else "letter"
    if token[-1].isdigit():
        return "ordinal" if token.isdigit() and len(token) <= 2 else "number"
    return "dotted" if "." in token else "word"


class _Closers:
    """Where a group that opens may close: the next closing character in its paragraph. Every stretch is searched once."""

    def __init__(self, text: str, n: int):
        self.text, self.ends, self.at, self.next = text, [*[m.start() for m in _PARAGRAPH.finditer(text, 0, n)], n], 0, {}

    def find(self, closer: str, pos: int) -> bool:
        while self.ends[self.at] < pos:
            self.at += 1
        seen_from, found = self.next.get(closer, (-1, -1))
        if not (seen_from >= 0 and (found >= pos or found == -1)):
            found = self.text.find(closer, pos, self.ends[-1])
            self.next[closer] = (pos, found)
        return 0 <= found < self.ends[self.at]


def choices(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """(end position, context) of every character that may end a sentence."""
    out: list[tuple[int, tuple[str, ...]]] = []
    n = len(text.rstrip())
    first = n - len(text[:n].lstrip())
    stack: list[tuple[str, str]] = []
    closers = _Closers(text, n)
    pos = first
    while pos < n:
        m = _STEP.search(text, pos, n)
        if m is None:
            break
        what, a, pos = m.lastgroup, m.start(), m.end()
        if what == "para":
            end = len(text[:a].rstrip())
            if out and out[-1][0] == end:
                out[-1] = (end, ("end", "paragraph"))
            elif end > first:
                out.append((end, ("end", "paragraph")))
            stack.clear()
        elif what == "open":
            c = m.group()
            if not closers.find(OPEN[c], pos):
                continue  # never closed in its paragraph: a stray character
            b = a - 1
            while b >= 0 and text[b].isspace():
                b -= 1
            before = "start" if b < first or text.count("\n", b + 1, a) > 1 or text[b] in MARKS or text[b] in CLOSE else "colon" if text[b] in ":：" else "mid"
            stack.append((OPEN[c], "bracket" if c in BRACKETS else before))
        elif what == "close":
            _unwind(stack, m.group())
        elif what == "gap":
            before, after = text[a - 1], text[pos]
            out.append((a, ("gap", "digit" if before.isdigit() else "letter", "digit" if after.isdigit() else "letter" if after.isalpha() else "other")))
        else:
            closed = "none"
            while pos < n:
                c = text[pos]
                step = 1
                if c.isspace() and any(x == "»" for x, _ in stack):
                    g = _SPACE.match(text, pos, n).end()
                    if g < n and text[g] == "»" and text[pos:g].count("\n") < 2:
                        c, step = "»", g + 1 - pos
                if (c in CLOSE or c == "“") and any(s == c for s, _ in stack):
                    closed = _unwind(stack, c)
                    pos += step
                else:
                    break
            marks = m.group()
            mark = marks[-1]
            kind = "dots" if len(marks) >= 2 and set(marks) <= set(".…") or mark == "…" else {".": "dot", ";": "semi", "；": "semi"}.get(mark, "wide" if mark in "。！？" else "native" if mark in "؟۔።।" else "loud")
            if kind == "semi":
                kind = "greek" if mark == ";" and a and "Ͱ" <= text[a - 1] <= "Ͽ" else "semi"
            g = _SPACE.match(text, pos, n).end()
            if g >= n:
                out.append((pos, ("end", "text")))
                continue
            white = text[pos:g]
            gap = "none" if g == pos else "space"
            if white.count("\n") > 1:
                out.append((pos, ("end", "paragraph")))
                continue
            token = _token(text[max(first, a - TOKEN_CHARS) : a]) if kind == "dot" else ""
            inside = stack[-1][1] if stack else "out"
            shape, word = _shape(token), _word(token)
            if shape == "ordinal":  # the word before it tells a day or a rank from a number
                word = "#" + _LAST_WORD.search(text, max(first, a - TOKEN_CHARS), a - len(token)).group(1).lower()
            out.append((pos, (kind, gap, _kind(text, g), shape, word, closed, inside)))
    if n > first:
        if out and out[-1][0] >= n:
            out[-1] = (n, ("end", "text"))
        else:
            out.append((n, ("end", "text")))
    return out


def _unwind(stack: list[tuple[str, str]], closer: str) -> str:
    """Close the innermost group that this character closes; groups left open inside it are dropped."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == closer:
            kind = stack[i][1]
            del stack[i:]
            return kind
    return "none"


class Words:
    """What is known of the words before marks: seen before a mark that ends nothing in the labelled text - always (inner)
    or not (mixed) -, or an abbreviation by the corpus."""

    def __init__(self, labelled: dict[str, str] | None = None, corpus: frozenset[str] = frozenset()):
        self.labelled, self.corpus = labelled or {}, corpus

    def role(self, shape: str, word: str) -> str:
        known = self.labelled.get(word)
        if known:
            return known
        if word in self.corpus:
            return "abbreviation"
        return shape


def features(context: tuple[str, ...], words: Words) -> tuple[str, ...]:
    if context[0] == "end":
        return ("end", f"end:{context[1]}")
    if context[0] == "gap":
        _, before, after = context
        return ("gap", f"gap<{before}", f"gap>{after}", f"gap:{before}:{after}")
    kind, gap, after, shape, word, closed, inside = context
    case = {"symbol": "upper", "open": "upper"}.get(after, after)
    role = words.role(shape, word)
    own = (f"w:{word}", f"wa:{word}:{case}") if word in words.labelled else ()
    return (f"k:{kind}", f"ka:{kind}:{after}", f"kc:{kind}:{case}", f"kg:{kind}:{gap}:{case}", f"r:{role}", f"ra:{role}:{case}", f"rg:{role}:{gap}:{case}", f"c:{closed}", f"ca:{closed}:{case}", f"ck:{closed}:{kind}", f"i:{inside}", f"ik:{inside}:{kind}:{closed}", f"all:{kind}:{gap}:{case}:{role}:{closed}:{inside}", *own)


class Model:
    """Weights of the features for a boundary, and of transitions by the tags and the distance of two choices."""

    def __init__(self, words: Words):
        self.words = words
        self.weight: dict[str, float] = defaultdict(float)
        self._cached = lru_cache(maxsize=65536)(self._score)

    def score(self, context: tuple[str, ...]) -> float:
        if len(context) == 7 and context[4] and context[4] not in self.words.labelled and context[4] not in self.words.corpus:
            context = (*context[:4], "", *context[5:])  # a word nothing is known of
        return self._cached(context)

    def _score(self, context: tuple[str, ...]) -> float:
        return sum(self.weight.get(f, 0.0) for f in features(context, self.words))

    def decode(self, found: list[tuple[int, tuple[str, ...]]], truth: list[bool] | None = None) -> list[bool]:
        """Viterbi over the choices. In training, ``truth`` makes every wrong tag look better by the margin."""
        score = self.score if truth is None else self._score
        w = self.weight
        step = {near: tuple(w.get(f"t:{x}:{near}", 0.0) for x in ("II", "BI", "IB", "BB")) for near in ("near", "far")}
        inside, boundary, back = 0.0, -1e18, []
        at = -1
        for i, (end, context) in enumerate(found):
            t_ii, t_bi, t_ib, t_bb = step["near" if at >= 0 and end - at < 4 else "far"]
            at = end
            ii, bi, ib, bb = inside + t_ii, boundary + t_bi, inside + t_ib, boundary + t_bb
            back.append((bi > ii, bb > ib))
            inside, boundary = max(ii, bi), max(ib, bb) + score(context)
            if truth is not None:
                boundary += -MARGIN if truth[i] else MARGIN
        tag = boundary >= inside
        tags = [tag]
        for from_inside, from_boundary in reversed(back[1:]):
            tag = from_boundary if tag else from_inside
            tags.append(tag)
        return tags[::-1] if found else []


def _labelled(example: str) -> tuple[str, set[int]]:
    parts = example.split("|")
    text, ends = "", set()
    for p in parts[:-1]:
        text += p
        ends.add(len(text))
    return text + parts[-1], ends


def _stripped(example: str) -> tuple[str, set[int]] | None:
    """Wide-script examples without their punctuation: a space where a sentence ended, spaces around numbers."""
    text, _ = _labelled(example)
    if sum("぀" <= c <= "鿿" for c in text) * 2 < len(text):
        return None
    out, ends = "", set()
    for i, part in enumerate(x for x in example.split("|") if x.strip()):
        words = " ".join(re.findall(r"[^\W\d_]+|\d+", "".join(c for c in part if c.isalnum())))
        out += (" " if i else "") + words + (" 12 " + words if i % 3 == 0 else "") + (" 7" if i % 4 == 1 else "")
        if not out[-1].isdigit():
            ends.add(len(out))
    return out, ends


def _stripped_choices(text: str) -> list[tuple[int, tuple[str, ...]]]:
    out: list[tuple[int, tuple[str, ...]]] = []
    for m in _STRIPPED_GAP.finditer(text):
        out.append((m.start(), ("gap", "digit" if text[m.start() - 1].isdigit() else "letter", "digit" if text[m.end()].isdigit() else "letter")))
    return out


def labelled_words(data: list[tuple[list, set[int]]]) -> dict[str, str]:
    """The words before marks that end nothing: inner if none of their marks does, else mixed. In quotations and before
    capitals in brackets it is the group that keeps the mark from ending something, and no word is blamed."""
    seen: dict[str, set[bool]] = defaultdict(set)
    for found, ends in data:
        for end, context in found:
            if len(context) == 7 and context[4] and (context[6] == "out" or context[6] == "bracket" and context[2] != "upper"):
                seen[context[4]].add(end in ends)
    return {w: "mixed" if True in s else "inner" for w, s in seen.items() if False in s}


def train(examples: list[str], corpus: frozenset[str] = frozenset(), epochs: int = EPOCHS) -> Model:
    """Averaged structured perceptron. So that it learns to trust the corpus, every passage is seen once with its words
    known, and once with those that the corpus has as abbreviations known by the corpus only."""
    data = [(choices(t), e) for t, e in map(_labelled, examples)]
    known = Words(labelled_words(data), corpus)
    inner = frozenset(w for w, role in known.labelled.items() if role == "inner" and not w.startswith("#"))
    by_corpus = Words({w: r for w, r in known.labelled.items() if w not in inner}, corpus | inner)
    stripped = [(_stripped_choices(t), e) for t, e in filter(None, map(_stripped, examples))]
    rounds = [*[(known, x) for x in data], *[(by_corpus, x) for x in data], *[(known, x) for x in stripped]]
    model, total, step = Model(known), defaultdict(float), 1
    for _ in range(epochs):
        for words, (found, ends) in rounds:
            model.words = words
            truth = [end in ends or context[0] == "end" for end, context in found]
            guess = model.decode(found, truth)
            if guess != truth:
                at = -1
                for i, (end, context) in enumerate(found):
                    near = "near" if at >= 0 and end - at < 4 else "far"
                    at = end
                    for tags, sign in ((truth, 1.0), (guess, -1.0)):
                        names = [(f, sign) for f in features(context, words)] if tags[i] else []
                        names.append((f"t:{'B' if i and tags[i - 1] else 'I'}{'B' if tags[i] else 'I'}:{near}", sign * TRANSITION_RATE))
                        for f, by in names:
                            model.weight[f] += by
                            total[f] += by * step
            step += 1
    for f in list(model.weight):
        model.weight[f] -= total[f] / step
    model.weight, model.words = dict(model.weight), known
    return model


@lru_cache(maxsize=2)
def model(corpus: frozenset[str] = frozenset()) -> Model:
    return train(EXAMPLES, corpus)


def ends(text: str, by: Model | None = None) -> list[int]:
    """End positions of the sentences of a text, in code points."""
    found = choices(text)
    return [end for (end, _), tag in zip(found, (by or model()).decode(found), strict=True) if tag]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch and word: how often with a mark behind it, with a small letter after that, and without a mark."""
    for batch in batches:
        tokens: Counter[str] = Counter()
        small: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            found = text.split()
            tokens.update(found)
            small.update([a for a, b in zip(found, found[1:]) if a[-1] == "." and b[0].islower()])
        seen: dict[str, list[int]] = {}
        for token, n in tokens.items():
            marked = token[-1] == "."
            if len(token) <= 16 and (w := _word(token.lstrip("(«„“（「[")[:-1] if marked else token.strip("(«„“（「[,;:!?)」）”»]"))):
                held = seen.setdefault(w, [0, 0, 0])
                held[0 if marked else 2] += n
                held[1] += small[token] if marked else 0
        rows = [(w, *n) for w, n in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["word", "marked", "small", "bare"])


def abbreviations(texts: DataFrame, share: float = SHARE) -> frozenset[str]:
    """Words of the column ``text`` that behave as abbreviations: marked more often than not, and a quarter of the times
    with a small letter after the mark. At most 1 / share words come back, whatever the number of texts."""
    words = texts.mapInArrow(_count_words, "word string, marked bigint, small bigint, bare bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("marked", "small", "bare")])
    words = cut_lineage(words.where(f"marked >= {LEAST_SEEN} and length(word) > 1"))
    total = words.agg(F.coalesce(F.sum("marked"), F.lit(0))).first()[0]
    found = words.where((F.col("marked") >= share * total) & (F.col("marked") > F.col("bare")) & (4 * F.col("small") >= F.col("marked")))
    return frozenset(r["word"] for r in found.select("word").collect())


def _tag(weights: dict[str, float], words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Model(words)
        by.weight = weights
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids, number, stop, start, text_out = [], [], [], [], []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    last = 0
                    for i, e in enumerate(ends(text, by)):
                        s = last
                        while s < e and text[s].isspace():
                            s += 1
                        ids.append(key)
                        number.append(i)
                        start.append(s)
                        stop.append(e)
                        text_out.append(text[s:e])
                        last = e
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(text_out, pa.string())], names=["doc_id", "sentence", "start_char", "end_char", "text"])

    return run


def sentences(df: DataFrame) -> DataFrame:
    """The sentences of every text: doc_id, sentence (from 0), start_char, end_char, text.

    ``df``: doc_id, text. ``end_char`` counts the code points of the stored text up to the sentence's last
    character, closing quotes and brackets included. Null, empty and blank texts have no sentence; a text without any
    mark is one; a null id is kept; repeated rows are cut again; an empty table gives no rows; extra columns are ignored.
    One pass counts the words before marks, a second tags; tagging is local to a row, and a text is never shortened.
    """
    texts = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    by = model(abbreviations(texts.select("text")))
    return texts.mapInArrow(_tag(by.weight, by.words), "doc_id bigint, sentence int, start_char int, end_char int, text string")


def p9_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_sentences(spark, folder).select("doc_id", "end_char")


QUERIES = {"p9_sentences": p9_sentences, "p9_found": p9_found}
ORACLE: dict[str, str] = {}
