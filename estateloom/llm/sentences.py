"""Sentence boundaries by a hidden-event n-gram language model, in any script.

Structure comes first: blank lines, headings, list items, table rows and field lines part blocks; inside a block the text
is a sequence of tokens with a hidden event, boundary or none, in every slot that may hold one: after end marks, at spaces
between words of scripts that write none, and in long stretches without any end mark between all words (in Chinese and
Japanese between all characters). The model predicts the event from the tokens before it and the next
token from the event: after a boundary the sentence-start n-grams, otherwise the n-grams that run on. Block starts and
ends are observed boundaries; all other events are hidden, so the n-gram counts are trained by expectation-maximisation,
and forward-backward posteriors decide in every document.

Spark counts: one pass tokenises all documents, sums in its tasks what is observed and how often each window of tokens
around slots occurs, and reduces both by key. What is expected in a slot depends on its window alone, so every further pass
reads the distinct windows with their counts instead of the texts. N-grams seen once back off to classes.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estateloom.functions.skew import spread
from estateloom.session import discard, written

PASSES = 2
#: distinct keys and tokens of windows that a task sums before it hands them on
HELD = 500_000
#: least tokens of a stretch without end marks that may hold several sentences
UNMARKED_TOKENS = 30

_CJK = "぀-ヿ一-鿿々〇ｦ-ﾟ"
_ENDS = ".!?…。！？．।॥؟۔።։။។"
_P = re.escape(".,;:!?…。！？．、，；：।॥؟۔؛،።։။។\"'“”„«»‹›「」『』《》【】（）()[]{}<>*|¿¡‘’")
_W = rf"[^\s{_P}{_CJK}]"
_TOKEN = re.compile(
    rf"(?P<open>(?:[\"'“„«‹「『《【（(\[{{¿¡‘<][   ]?){{0,8}})"
    rf"(?P<word>[{_CJK}]|{_W}+(?:[.,:'’!?;=]+(?={_W}){_W}+)*|[*|<>{{}}]+)"
    rf"(?P<tail>(?:[   ]?[!?;:»]+|[ ]?\.\.\.|[ ]?…+|[.,。！？．、，；：।॥؟۔؛،።։။។…\"”’'»›」』》】）)\]!?;:]+)*)"
)
_GERMAN = re.compile(r"„([^„“”\n]*)“")
_CLOSERS = "\"”’'»›」』》】）)]"
_NO_SPACE_ENDS = "。！？．。"
_THAI = re.compile(r"[฀-๿]")
#: Thai, Lao, Burmese and Khmer write spaces between phrases and sentences only
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")

_HEADING = re.compile(r"\s*#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:[-*•–·]|\(?\d{1,3}[.)]|\(?[a-z][.)](?=\s+[A-Z]))\s+(?=\S)")
_ROW = re.compile(r"\s*\|")
_DASHES = re.compile(r"\s*\|?[\s|:+-]*-[\s|:+-]*\|?\s*$")
_FIELD = re.compile(r"\s*[^\W\d_][\w-]*(?:[ /][\w-]+){0,2}\s?[:：](?!//)\s*\S")

_SHORT_FIELD = re.compile(r"\s*[A-ZÀ-Þ][\w-]*: [^\"'“„«‹「]+$")

_HOST = re.compile(r"(?=.*\d)[a-z][a-z0-9]*(?:-[a-z0-9]+)+")
_FILE = re.compile(r"[\w.-]*\w\.[a-z]{2,6}")


@dataclass(slots=True)
class Token:
    start: int
    end: int
    core: str
    tail: str
    quoted: bool
    last: str
    first: str


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): stretches of ``text``; of a ``whole`` one only the start counts."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    open_: list[int] | None = None
    for i, (start, end, line) in enumerate(lines):
        if not line.strip():
            if open_:
                yield open_[0], open_[1], False
            open_ = None
            continue
        first = start + len(line) - len(line.lstrip())
        special = bool(_HEADING.match(line)) or bool(_ROW.match(line))
        blank = lambda k: not 0 <= k < len(lines) or not lines[k][2].strip()
        alone = blank(i - 1) and (blank(i + 1) or bool(_FIELD.match(lines[i + 1][2])))
        # what somebody said after a colon is a sentence; a short value behind one capitalised word is a field, however it ends
        field = alone and bool(_FIELD.match(line)) and (line.rstrip()[-1] not in _ENDS + "\"”»」’'" or (len(line) <= 60 and bool(_SHORT_FIELD.match(line))))
        if special or field:
            if open_:
                yield open_[0], open_[1], False
            open_ = None
            if not (_ROW.match(line) and _DASHES.match(line)):
                yield first, end, True
        elif _ITEM.match(line):
            if open_:
                yield open_[0], open_[1], False
            yield first, end, False
            open_ = None
        elif open_:
            open_[1] = end
        else:
            open_ = [first, end]
    if open_:
        yield open_[0], open_[1], False


@lru_cache(maxsize=1 << 17)
def _core(word: str) -> str:
    if word.isdigit():
        return "#"
    if word[0].isdigit():
        return "#IP" if word.count(".") == 3 else "#.#" if re.fullmatch(r"[\d.,:%]+", word) else "#a"
    if word[0] in "vV" and re.fullmatch(r"[vV]\d+(?:\.\d+)*", word):
        return "#.#"
    if len(word) == 1 and word.isupper():
        return "#X"
    if "://" in word:
        return "#URL"
    if _HOST.fullmatch(word):
        return "#HOST"
    if "." in word and _FILE.fullmatch(word) and len(word) > 6:
        return "#FILE"
    return word if len(word) <= 24 else f"{word[:8]}~{zlib.crc32(word.encode()):08x}"


@lru_cache(maxsize=1 << 17)
def _shape(core: str) -> str:
    if core[0] == "#":
        return core
    c = core[0]
    if c.isupper():
        return "Aa" if not core.isupper() else "AA"
    if c.islower():
        return "aa"
    return "zh" if re.match(f"[{_CJK}]", c) else "th" if _THAI.match(c) else "o" if c.isalpha() else "-"


class Tokens:
    """Tokens of a block, made when they are asked for: most are not near a slot."""

    __slots__ = ("matches", "raws", "made", "offset")

    def __init__(self, matches: list[re.Match], offset: int):
        self.matches, self.offset = matches, offset
        self.raws = [m[0] for m in matches]
        self.made: dict[int, Token] = {}

    def __len__(self) -> int:
        return len(self.matches)

    def __getitem__(self, i: int) -> Token:
        if (t := self.made.get(i)) is None:
            if i >= len(self.matches):
                raise IndexError(i)
            m = self.matches[i]
            opened, word, tail = m.groups()
            if " " in tail or "\xa0" in tail or "\u202f" in tail:
                tail = "".join(tail.split())
            quoted = bool(opened) and any(c in "\"'“„«‹「『‘" for c in opened)
            t = self.made[i] = Token(self.offset + m.start(), self.offset + m.end(), _core(word), tail, quoted, word[-1], word[0])
        return t


def tokens(text: str, start: int, end: int) -> Tokens:
    """Tokens of a block; single line breaks read as spaces, German closing quotes as such."""
    return Tokens(list(_TOKEN.finditer(_GERMAN.sub("„\\1”", text[start:end].replace("\n", " ")))), start)


@lru_cache(maxsize=1 << 12)
def _tail_kind(tail: str) -> str:
    ends = "".join(dict.fromkeys(c for c in tail if c in _ENDS))
    return ends[:2] + ("…" if tail.count(".") > 2 else "") + ("Q" if any(c in "\"”’'»›」』》" for c in tail) else "") + (")" if any(c in "）)]】" for c in tail) else "")


_MARKER = re.compile(r"#|[-*•–·]|#X|[a-z]")
_ONE_CJK = re.compile(f"[{_CJK}]")
_HAS_END = re.compile(f"[{re.escape(_ENDS)}]")


class _Behind(dict):
    """What a slot behind a token would go by, from the text of the token: 1 an end mark, 2 a script without spaces, 0 nothing."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        word_end = _TOKEN.match(raw).end(2)
        if word_end == len(raw):
            kind = 2 if _SPACELESS.match(raw, word_end - 1) else 0
        else:
            kind = 1 if _HAS_END.search(raw, word_end) else 0
        self[raw] = kind
        return kind


_BEHIND = _Behind()


def slots(text: str, toks: Tokens, item: bool) -> list[int]:
    """Indexes of tokens behind which a boundary may stand."""
    out = []
    behind = list(map(_BEHIND.__getitem__, toks.raws))
    marked = 1 in behind
    for i in [i for i, kind in enumerate(behind[:-1]) if kind]:
        a, b = toks[i], toks[i + 1]
        tail = a.tail
        if item and i == 0 and _MARKER.fullmatch(a.core):
            continue  # the marker of a list item
        gap = a.end < b.start or text[a.end - 1].isspace()
        if tail:
            if tail[-1] not in _ENDS and tail[-1] not in _CLOSERS:
                continue
            if gap or any(c in _NO_SPACE_ENDS for c in tail) or (tail[-1] in _CLOSERS and _ONE_CJK.match(a.last)):
                out.append(i)
        elif gap and _SPACELESS.match(b.first):
            out.append(i)
    if not out and not marked and len(toks) >= UNMARKED_TOKENS:
        # no mark anywhere, so any place between two words may be a boundary
        for i in range(1 if item else 0, len(toks) - 1):
            a, b = toks[i], toks[i + 1]
            if not a.tail and (a.end < b.start or text[b.start].isspace() or (_ONE_CJK.match(a.last) and _ONE_CJK.match(b.first))):
                out.append(i)
    elif marked and any("\u1000" <= toks[i].last <= "\u17ff" for i in out):
        out = [i for i in out if toks[i].tail]  # where Burmese or Khmer has its marks, a space parts phrases
    return out


class Model:
    """Backed-off probabilities from counts keyed by text.

    ``e*`` count left contexts: at observed block ends (``|1``), in slots (``|c``), and events expected in slots (``|x``);
    ``s*`` count starts, observed and expected; ``r*`` running tokens; ``n*`` tokens that run on behind a mark.
    """

    LEXICON = 3000.0  # words of a shape, for words never seen
    MOST = 0.998

    def __init__(self, counts: dict[str, float]):
        self.c = counts
        self.expected = counts.get("passes|", 0.0) > 0
        self._cache: dict[tuple, float] = {}
        ends = sum(counts.get(f"k|{k}|1", 0.0) for k in "!?。！？।؟")
        slots_ = sum(counts.get(f"k|{k}|c", 0.0) for k in "!?。！？।؟")
        #: share of tokens that open a sentence, for text without marks
        self.rate = (counts.get("s|", 0.0) + 1.0) / (counts.get("s|", 0.0) + counts.get("r|", 0.0) + 15.0)
        #: share of block ends among sentence ends, by the marks that are hardly ever anything else
        self.rho = (ends + 1.0) / (ends + slots_ + 4.0)

    def cached(self, f: Callable[..., float], key: tuple, *args: object) -> float:
        """``f`` of ``args``, kept under ``key``; contexts repeat as words do."""
        if (p := self._cache.get(key)) is None:
            if len(self._cache) > 500_000:
                self._cache.clear()
            p = self._cache[key] = f(*args)
        return p

    def event(self, before: str, a: Token) -> float:
        """P(boundary) before the next token is seen: how often the context ends a block, against the share of sentences that do."""
        if not a.tail and not _SPACELESS.match(a.last):
            # how often a sentence ends with this word where marks say so, against how often it runs on
            ends = self.c.get(f"z|{a.core}", 0.0)
            return min((ends + 4.0 * self.rate) / (ends + self.c.get(f"b1|{a.core}", 0.0) + 4.0), self.MOST)
        if not a.tail:
            p = self.MOST  # a space where the script writes none between words
            return (self.c.get("e1|||x", 0.0) + 2.0 * p) / (self.c.get("e1|||c", 0.0) + 2.0) if self.expected else p
        c, kind = self.c, _tail_kind(a.tail)
        r, x = self.rho * 0.7, None
        # a full stop may belong to the word before it, and a quotation to the sentence around it; other marks end by themselves
        lexical = "." in kind or "Q" in kind or "…" in kind
        for key, k in ((f"e0|{kind}|{_shape(a.core)}", 4.0), (f"e1|{kind}|{a.core}", 4.0), (f"e2|{kind}|{a.core}|{before}", 4.0)) if lexical else ((f"k|{kind}", 4.0),):
            ends, at = c.get(key + "|1", 0.0), c.get(key + "|c", 0.0)
            r = (ends + k * r) / (ends + at + k)
            if self.expected:
                x = (c.get(key + "|x", 0.0) + 3.0 * (min(r / self.rho, 1.0) if x is None else x)) / (at + 3.0)
        p = min(r / self.rho, 1.0)
        return min(max(p if x is None else 0.5 * (p + x), 0.004), 0.8 if "…" in kind else self.MOST)

    def _token(self, family: str, total: float, b: Token) -> float:
        c, lexical = self.c, 1.0 if b.core[0] == "#" else self.LEXICON
        if c.get(f"s1|{b.core}|{b.quoted}", 0.0) + c.get(f"r1|{b.core}|{b.quoted}", 0.0) < 2.0:
            return (c.get(f"{family}0|{_shape(b.core)}|{b.quoted}", 0.0) + 0.2) / (total + 5.0) / lexical  # a new word tells by its shape
        p = (c.get(f"{family}0|{_shape(b.core)}|{b.quoted}", 0.0) + 0.2) / (total + 5.0) / lexical
        return (c.get(f"{family}1|{b.core}|{b.quoted}", 0.0) + 3.0 * p) / (total + 3.0)

    def start(self, b: Token, after: str) -> float:
        p = self._token("s", self.c.get("s|", 0.0), b)
        pair = (self.c.get(f"s2|{b.core}|{after}", 0.0) + 2.0 * self.pair(b, after)) / (self.c.get(f"s3|{b.core}", 0.0) + 2.0)
        return p * pair

    def running(self, a: Token, b: Token, after: str) -> float:
        c, kind = self.c, _tail_kind(a.tail)
        p = self._token("r", c.get("r|", 0.0), b)
        if not a.tail:
            p = (c.get(f"b2|{a.core}|{b.core}", 0.0) + 4.0 * p) / (c.get(f"b1|{a.core}", 0.0) + 4.0)
        p = (c.get(f"n1|{kind}|{b.core}|{b.quoted}", 0.0) + 500.0 * p) / (c.get(f"n|{kind}", 0.0) + 500.0)
        p = (c.get(f"n2|{kind}|{a.core}|{b.core}|{b.quoted}", 0.0) + 50.0 * p) / (c.get(f"n3|{kind}|{a.core}", 0.0) + 50.0)
        return p * self.pair(b, after)

    def pair(self, b: Token, after: str) -> float:
        """The token after next, given the next one, wherever the pair stands."""
        return (self.c.get(f"w2|{b.core}|{after}", 0.0) + 0.01) / (self.c.get(f"w1|{b.core}", 0.0) + 1.0)


def posteriors(model: Model, text: str, toks: Tokens, at: list[int]) -> list[float]:
    """P(boundary) of each slot by forward-backward; adjacent slots share a token, so their events depend on each other."""
    emit, prior = [], []
    for k, i in enumerate(at):
        a, b = toks[i], toks[i + 1]
        after = toks[i + 2].core if i + 2 < len(toks) else "</s>"
        kind = _tail_kind(a.tail)
        run = model.cached(model.running, ("r", a.core, kind, b.core, b.quoted, after), a, b, after)
        start = model.cached(model.start, ("s", b.core, b.quoted, after), b, after)
        emit.append((max(run, 1e-12), max(start, 1e-12)))
        history = toks[i - 1].core + _tail_kind(toks[i - 1].tail) if i else "<s>"
        # the token before counts as history only if no boundary parts it from this one
        own = model.cached(model.event, ("e", a.core, kind, history), history, a)
        adjacent = k > 0 and at[k - 1] == i - 1
        prior.append((own, model.cached(model.event, ("e", a.core, kind, "<s>"), "<s>", a) if adjacent or i == 0 else own))
    n = len(at)
    forward: list[tuple[float, float]] = []
    state = (0.0, 1.0) if at and at[0] == 0 else (1.0, 0.0)
    for k in range(n):
        if k and at[k] != at[k - 1] + 1:
            state = (1.0, 0.0)
        p = state[0] * prior[k][0] + state[1] * prior[k][1]
        x = ((1 - p) * emit[k][0], p * emit[k][1])
        z = x[0] + x[1]
        state = (x[0] / z, x[1] / z)
        forward.append(state)
    backward = [(1.0, 1.0)] * n
    for k in range(n - 2, -1, -1):
        if at[k + 1] != at[k] + 1:
            continue
        out = []
        for e in (0, 1):
            p = prior[k + 1][e]
            out.append((1 - p) * emit[k + 1][0] * backward[k + 1][0] + p * emit[k + 1][1] * backward[k + 1][1])
        z = sum(out)
        backward[k] = (out[0] / z, out[1] / z)
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]


class Observed(dict):
    """What texts show of the model, summed by numbers of tokens; as a dict, the number of a token by its text.

    Neighbours, block starts and ends, and the windows around slots: from the token before the first of adjacent slots to the
    second token after the last. Events in a window depend on nothing outside it.
    """

    START, END = 0, 1

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.kinds: dict[tuple, int] = {("", "", False, "", False): self.START, ("</s>", "", False, "", False): self.END}
        self.pairs, self.parted, self.begun, self.ended, self.windows = Counter(), Counter(), Counter(), Counter(), Counter()
        self.texts = self.held = 0

    def __missing__(self, raw: str) -> int:
        t = tokens(raw, 0, len(raw))[0]
        kind = (t.core, t.tail, t.quoted, "" if t.tail or not _SPACELESS.match(t.last) else t.last, t.first.islower())
        n = self[raw] = self.kinds.setdefault(kind, len(self.kinds))
        return n

    def full(self) -> bool:
        return max(len(self), len(self.pairs), self.held) > HELD

    def add(self, text: str) -> None:
        self.texts += 1
        for start, end, whole in blocks(text):
            if whole:
                continue
            toks = tokens(text, start, end)
            if not len(toks):
                continue
            item = bool(_ITEM.match(text[start:end]))
            skip = 1 if item and len(toks) > 1 else 0
            at = slots(text, toks, item)
            ids = [self.START, *map(self.__getitem__, toks.raws), self.END]  # token i is ids[i + 1]
            self.pairs.update(zip(ids[1:], ids[2:], strict=False))
            self.begun[ids[skip + 1], ids[skip + 2]] += 1
            self.ended[ids[-3], ids[-2]] += 1
            for i in {0, *at} if skip else at:
                self.parted[ids[i + 1], ids[i + 2]] += 1
            first = 0
            for k, i in enumerate(at):
                if k + 1 == len(at) or at[k + 1] != i + 1:
                    window = tuple(ids[at[first] : i + 4])
                    first = k + 1
                    self.windows[window] += 1
                    if self.windows[window] == 1:
                        self.held += len(window)

    def sums(self) -> dict[str, float]:
        """All that was added, under text keys: n-grams, and windows behind their mark."""
        kinds = list(self.kinds)
        toks = [Token(0, 0, core, tail, quoted, last, "") for core, tail, quoted, last, _ in kinds]
        counts: dict[str, float] = defaultdict(float)
        for (i, j), n in self.pairs.items():
            a, b = toks[i], toks[j]
            if not kinds[i][4]:  # pairs are asked for only where a sentence may start
                counts[f"w1|{a.core}"] += n
                if j != self.END:
                    counts[f"w2|{a.core}|{b.core}"] += n
            runs = n - self.parted[i, j] if (i, j) in self.parted else n
            if runs and j != self.END:
                _count_running(counts, b, runs)
                if not a.tail:
                    counts[f"b1|{a.core}"] += runs
                    counts[f"b2|{a.core}|{b.core}"] += runs
        for (i, j), n in self.begun.items():
            _count_start(counts, toks[i], toks[j].core, n)
        before = lambda i: toks[i].core + _tail_kind(toks[i].tail) if i != self.START else "<s>"
        for (i, j), n in self.ended.items():
            if any(c in _ENDS for c in toks[j].tail):
                _count_event(counts, before(i), toks[j], "1", n)
        for window, n in self.windows.items():
            for i, j in zip(window[:-3], window[1:], strict=False):
                _count_event(counts, before(i), toks[j], "c", n)
            counts[_window_key([toks[i] for i in window])] += n
        counts["passes|"] += self.texts
        return counts


_WINDOW, _NEXT, _PART = "\x1d", "\x1e", "\x1f"  # tokens hold none of them: they count as white space


def _window_key(window: list[Token]) -> str:
    """A window as text, with what the events in it depend on and no more."""
    before, *inner, after = window
    parts = [before.core + _tail_kind(before.tail)]  # empty where a block starts
    for k, t in enumerate(inner):
        tail, last = (t.tail, t.last) if k + 1 < len(inner) else ("", "")
        parts.append(_PART.join((t.core, tail, "Q" if k and t.quoted else "", last)))
    return _WINDOW + _NEXT.join((*parts, after.core))


def expected_counts(model: Model, window: str, n: float, counts: dict[str, float]) -> None:
    """Adds the counts that are expected in the slots of a window seen ``n`` times."""
    before, *inner, after = window[1:].split(_NEXT)
    toks = [Token(0, 0, before, "", False, "", "")] if before else []
    at = range(len(toks), len(toks) + len(inner) - 1)
    for part in inner:
        core, tail, quoted, last = part.split(_PART)
        toks.append(Token(0, 0, core, tail, bool(quoted), last, ""))
    toks.append(Token(0, 0, after, "", False, "", ""))
    for i, p in zip(at, posteriors(model, "", toks, at), strict=True):
        a, b = toks[i], toks[i + 1]
        _count_event(counts, toks[i - 1].core + _tail_kind(toks[i - 1].tail) if i else "<s>", a, "x", n * p)
        _count_start(counts, b, toks[i + 2].core, n * p)
        runs = n * (1.0 - p)
        _count_running(counts, b, runs)
        kind = _tail_kind(a.tail)
        for key in (f"n|{kind}", f"n1|{kind}|{b.core}|{b.quoted}", f"n2|{kind}|{a.core}|{b.core}|{b.quoted}", f"n3|{kind}|{a.core}"):
            counts[key] += runs


def _count_event(counts: dict[str, float], before: str, a: Token, what: str, n: float) -> None:
    kind = _tail_kind(a.tail)
    counts[f"k|{kind}|{what}"] += n
    if what != "c" and a.tail:
        counts[f"z|{a.core}"] += n
    for key in (f"e0|{kind}|{_shape(a.core)}", f"e1|{kind}|{a.core}" if a.tail else "e1||" if _SPACELESS.match(a.last) else "e1|~|", f"e2|{kind}|{a.core}|{before}"):
        counts[f"{key}|{what}"] += n


def _count_start(counts: dict[str, float], b: Token, after: str, p: float) -> None:
    for key in ("s|", f"s0|{_shape(b.core)}|{b.quoted}", f"s1|{b.core}|{b.quoted}", f"s2|{b.core}|{after}", f"s3|{b.core}"):
        counts[key] += p


def _count_running(counts: dict[str, float], b: Token, n: float) -> None:
    for key in ("r|", f"r0|{_shape(b.core)}|{b.quoted}", f"r1|{b.core}|{b.quoted}"):
        counts[key] += n


def _inside_quotes(text: str, start: int, boundary: list[int], end: int) -> set[int]:
    """Boundaries inside a quotation behind whose end the outer sentence goes on."""
    marks, ordered = set(boundary), sorted(boundary)
    bad: set[int] = set()
    for m in re.finditer(r"„[^„”“]*[”“]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|(?<![^\s(\[])\"[^\"]*\"(?!\w)", text[start:end]):
        inner = ordered[bisect_right(ordered, start + m.start()) : bisect_left(ordered, start + m.end())]
        rest = re.match(r"\s*", text[start + m.end() : end])
        after = start + m.end() + rest.end()
        if inner and after < end and after not in marks:
            bad.update(inner)
    return bad


def starts(model: Model, text: str) -> list[int]:
    """Code-point position of the first character of each sentence unit of ``text``."""
    out = []
    for start, end, whole in blocks(text):
        out.append(start)
        if whole:
            continue
        toks = tokens(text, start, end)
        at = slots(text, toks, bool(_ITEM.match(text[start:end])))
        found = [toks[i + 1].start for i, p in zip(at, posteriors(model, text, toks, at), strict=True) if p > 0.5]
        bad = _inside_quotes(text, start, found, end) if found else set()
        out += [b for b in found if b not in bad]
    return out


_COUNTS = pa.schema([("ngram", pa.string()), ("n", pa.float64())])


def _batch(counts: dict[str, float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.float64())], schema=_COUNTS)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ngram").agg(F.sum("n").alias("n"))


def _observed(documents: DataFrame) -> DataFrame:
    """(ngram, n): what all documents show, and the windows around their slots."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Observed()
        for b in it:
            for text in b.column("text").to_pylist():
                if text:
                    seen.add(text)
                if seen.full():  # pre-aggregated, not kept for a whole split
                    yield _batch(seen.sums())
                    seen.clear()
        yield _batch(seen.sums())

    return _summed(documents.select("text").mapInArrow(batches, "ngram string, n double"))


def _expected(windows: DataFrame, model: dict[str, float]) -> DataFrame:
    """(ngram, n): what ``model`` expects in the slots of all windows, not yet summed over tasks."""
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        counts: dict[str, float] = defaultdict(float)
        for b in it:
            for window, n in zip(b.column("ngram").to_pylist(), b.column("n").to_pylist(), strict=True):
                expected_counts(m, window, n, counts)
            if len(counts) > HELD:
                yield _batch(counts)
                counts.clear()
        yield _batch(counts)

    return windows.mapInArrow(batches, "ngram string, n double")


def _collected(counts: DataFrame) -> dict[str, float]:
    """The n-grams seen more than once; they grow with the words and pairs of the texts, not with their length."""
    return {r.ngram: r.n for r in counts.where("n >= 1.5").collect()}


def training_documents(documents: DataFrame, most_chars: int | None = None) -> DataFrame:
    """All documents. Only a caller that names ``most_chars`` gets a share by hashed id with about as many; no query does."""
    texts = documents.select("doc_id", "text")
    if most_chars is None:
        return texts
    total = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return texts if total <= most_chars else texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_chars / total))


def train(documents: DataFrame, passes: int = PASSES) -> dict[str, float]:
    """Counts of the model over all documents: the first pass from observed block edges alone, each further one also from posteriors."""
    counts = written(_observed(spread(training_documents(documents), "doc_id")))
    window = F.col("ngram").startswith(_WINDOW)
    seen = counts.where(~window)
    model = _collected(seen.where("ngram <> 'passes|'")) if passes else {}
    for _ in range(passes - 1):
        model = _collected(_summed(seen.unionAll(_expected(spread(counts.where(window), "ngram"), model))))
    discard(counts)
    return model


def sentence_units(documents: DataFrame, model: dict[str, float] | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, start_pos, end_pos, sentence): every sentence unit of every document, in code points from 0; without ``with_text`` only where it starts.

    Edge cases: null, empty and blank texts have no units; repeated texts have theirs under each ``doc_id``; an empty table
    gives an empty table (and an untrained model, which splits by priors); very long texts are read whole; further columns
    are ignored. ``lang`` is not used, as it may be missing or wrong.
    """
    trained = documents.sparkSession.sparkContext.broadcast(train(documents) if model is None else model)
    schema = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), *([("end_pos", pa.int64()), ("sentence", pa.string())] if with_text else [])])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(trained.value)
        for b in it:
            ids, begin, stop, said = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                edges = starts(m, text)
                ids += [doc_id] * len(edges)
                begin += edges
                if not with_text:
                    continue
                limits = {s: e for s, e, _ in blocks(text)}
                stop_at = 0
                for i, s in enumerate(edges):
                    stop_at = limits.get(s, stop_at)
                    e = min(edges[i + 1] if i + 1 < len(edges) else len(text), stop_at)
                    unit = text[s:e].rstrip()
                    stop.append(s + len(unit)), said.append(unit)
            columns = [ids, begin, stop, said] if with_text else [ids, begin]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id bigint, start_pos bigint" + (", end_pos bigint, sentence string" if with_text else "")
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(batches, ddl)
