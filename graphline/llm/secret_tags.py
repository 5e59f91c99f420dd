"""Secrets in texts: fixed patterns, and a linear-chain conditional random field beside them.

Words are tagged as outside, begin or inside of a secret. A word's scores come from
its own shape, the shapes of the words before and after it, and features of its
document (language, source, how many of its words have digits); transitions join
the tags of neighbours. The tags of the highest score are found by Viterbi.

Scores of a word are computed once per distinct word of a batch and looked up for
all places. A word that is outside whatever its neighbours' tags are (its lead is
larger than any gain by transitions) needs no program, so Viterbi runs exactly on
the short stretches in between; the tests hold this against Viterbi on whole texts.

The field is trained in the driver on a bounded sample: windows around the pattern
matches of the ``SAMPLE_ROWS`` documents of smallest hash, up to ``SAMPLE_BYTES``
each, and as many windows with secrets of stated forms planted into them. Texts
never leave their rows for tagging, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.encode import text_slices

#: Fixed patterns: kind, pattern, group that is measured, least characters of it.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
TAGGED = "crf"
KINDS = [kind for kind, *_ in BASE] + [TAGGED]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYWORDS = frozenset("pass password passwd passphrase pwd secret token api_key apikey key credential auth bearer".split())
#: Quotes and brackets round a word, and an assignment before a value, aren't part of the secret.
VALUE = re.compile(r"""^["'`(<\[{]*(?:[A-Za-z_]{1,32}["']?[:=]+["']?)?(.*?)["'`)>\]},;.!?]*$""", re.DOTALL)

OUTSIDE, BEGIN, INSIDE = range(3)
SAMPLE_ROWS, SAMPLE_BYTES, AROUND, SEED = 1500, 1 << 15, 8, 11
#: A document's share of words with digits falls into one of these ranges.
DIGIT_SHARES = (0.01, 0.03, 0.1)
GROUPS = 8
MAX_WORDS, SCORE_WORDS = 1 << 19, 1 << 18

Span = tuple[int, int, int]


#: Every match of the first pattern holds one of these, whatever its case.
HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of the fixed patterns' matches."""
    found, small = [], text.lower()
    for number, (kind, pattern, group, least) in enumerate(BASE):
        if kind != "assign" or any(hint in small for hint in HINTS):
            found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


LENGTHS = (4, 8, 12, 16, 20, 24, 32, 48)
SHAPES = (
    *(f"length below {n}" for n in LENGTHS), "longer", "digit", "upper", "lower", "digit and letter", "upper, lower and digit", "digits alone", "hex digits alone", "letters alone", "beyond ASCII",
    "sign inside", "many changes", "few changes", "varied", "keyword", "ends an assignment", "assignment inside", "quoted", "capital and digit, no lower", "address", "digits and dots", "bracketed", "constant",
)
VARIED = SHAPES.index("varied")
SIGNED = ("ends an assignment", "assignment inside", "quoted", "address", "bracketed")
LEADING, TRAILING = "\"'`(<[{", "\"'`)>]},;.!?"
BARE = "\"'`()<>[]{},;.!?:="
ASSIGNED = re.compile(r"""["']?[A-Za-z_]{1,32}["']?[:=]["']?.""", re.DOTALL)
SIGN, LOWER, UPPER, DIGIT = range(4)
HEAD = 256


def _kind(c: str) -> int:
    return DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else SIGN


ASCII_KINDS = np.array([_kind(chr(c)) for c in range(128)], np.int8)
#: What is counted of a core, ten bits each, so that one sum serves all: the kinds, hex digits, digits and dots, changes of kind.
COUNTED = {name: 1 << (10 * k) for k, name in enumerate(("upper", "lower", "digit", "hex", "dotted", "change"))}
ADDED = np.array([COUNTED["upper"] * (k == UPPER) + COUNTED["lower"] * (k == LOWER) + COUNTED["digit"] * (k == DIGIT) for k in range(4)], np.int64)
ALSO = np.array([COUNTED["hex"] * (chr(c) in "0123456789abcdefABCDEF") + COUNTED["dotted"] * (chr(c) in "0123456789,-./:") for c in range(128)], np.int64)


def _core(head: str) -> str:
    if head.isalnum():
        return head
    return VALUE.match(head)[1] if "=" in head or ":" in head else head.lstrip(LEADING).rstrip(TRAILING)


def shapes(words: list[str]) -> np.ndarray:
    """Which of the SHAPES each word has, (words, shapes) as 0 and 1; of very long words the first 256 characters and the length count."""
    n = len(words)
    heads = [w if len(w) <= HEAD else w[:HEAD] for w in words]
    cores = [_core(w) for w in heads]
    sizes = np.fromiter(map(len, cores), np.int64, n)
    whole = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = ASCII_KINDS[np.minimum(codes, 127)]
    far = np.flatnonzero(codes > 127)
    if len(far):
        each, which = np.unique(codes[far], return_inverse=True)
        kinds[far] = np.array([_kind(chr(c)) for c in each], np.int8)[which]

    weights = ADDED[kinds]
    near = codes < 128
    weights[near] += ALSO[codes[near]]
    step = np.zeros(len(kinds), bool)
    step[1:] = kinds[1:] != kinds[:-1]
    step[(ends - sizes)[sizes > 0]] = False  # between two words
    weights[step] += COUNTED["change"]
    total = np.concatenate([[0], np.cumsum(weights)])
    sums = total[ends] - total[ends - sizes]
    uppers, lowers, digits, hexes, dotted, changes = ((sums // each) & 1023 for each in COUNTED.values())
    signs, changes = sizes - uppers - lowers - digits, changes / np.maximum(1, sizes - 1)
    long = np.where(whole <= HEAD, sizes, whole)
    digit, upper, lower = digits > 0, uppers > 0, lowers > 0
    has = np.zeros((n, len(SHAPES)))
    put = lambda name, flags: has.__setitem__((slice(None), SHAPES.index(name)), flags)
    has[np.arange(n), np.searchsorted(LENGTHS, long, "right")] = 1
    put("digit", digit)
    put("upper", upper)
    put("lower", lower)
    put("digit and letter", digit & (upper | lower))
    put("upper, lower and digit", digit & upper & lower)
    put("digits alone", digit & ~upper & ~lower & (signs == 0))
    put("hex digits alone", digit & (hexes == sizes))
    put("letters alone", (sizes > 0) & ~digit & (signs == 0))
    put("sign inside", signs > 0)
    put("many changes", (long >= 8) & (changes >= 0.3))
    put("few changes", (long >= 8) & (changes > 0) & (changes < 0.3))
    put("capital and digit, no lower", upper & digit & ~lower)
    put("digits and dots", digit & ~upper & ~lower & (dotted == sizes))
    put("beyond ASCII", np.fromiter((not w.isascii() for w in heads), bool, n))
    put("keyword", np.fromiter((w.strip(BARE).lower() in KEYWORDS for w in heads), bool, n))
    put("constant", True)
    for k in np.flatnonzero(long >= 12).tolist():
        has[k, VARIED] = len(set(cores[k])) >= 10
    signed = [k for k, w in enumerate(heads) if not w.isalnum()]
    rest = np.array([[w[-1:] in ":=", ("=" in w or ":" in w) and bool(ASSIGNED.match(w)), w[:1] in "\"'`", "@" in w[1:-1], w[:1] in "([{<" or w[-1:] in ")]}>"] for w in map(heads.__getitem__, signed)]).reshape(len(signed), len(SIGNED))
    for name, flags in zip(SIGNED, rest.T, strict=True):
        has[signed, SHAPES.index(name)] = flags
    return has


def group(name: str, value: str | None) -> int:
    """One of a few groups of languages or sources."""
    return hashlib.blake2b(f"{name}:{value}".encode("utf-8", "surrogatepass"), digest_size=2).digest()[0] % GROUPS


DOCUMENT_FEATURES = 2 * GROUPS + len(DIGIT_SHARES) + 1
FEATURES = 4 * len(SHAPES) + DOCUMENT_FEATURES


def document_features(lang: str | None, source: str | None, digit_share: float) -> list[int]:
    return [group("lang", lang), GROUPS + group("source", source), 2 * GROUPS + int(np.searchsorted(DIGIT_SHARES, digit_share, "right"))]


@dataclass
class Field:
    """Weights of a trained field: features of a word, of the one before, the one before that and the one after it, and of its document; transitions."""

    weights: np.ndarray
    transitions: np.ndarray

    def part(self, number: int) -> np.ndarray:
        size = len(SHAPES)
        return self.weights[number * size : (number + 1) * size]

    @property
    def of_document(self) -> np.ndarray:
        return self.weights[4 * len(SHAPES) :]

    def leads(self) -> np.ndarray:
        """How far outside has to lead before begin and inside for them to be out of the question."""
        t = self.transitions
        return np.array([max(t[a, x] + t[x, b] - t[a, OUTSIDE] - t[OUTSIDE, b] for a in range(3) for b in range(3)) for x in (BEGIN, INSIDE)])

    def viterbi(self, scores: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
        """Tags of a stretch, between the given tags; of equal scores the smaller tags from the end."""
        t, table = self.transitions.tolist(), scores.tolist()
        best = [s + (t[before][x] if before is not None else 0.0) for x, s in enumerate(table[0])]
        back = []
        for row in table[1:]:
            came = [max(range(3), key=lambda a: best[a] + t[a][x]) for x in range(3)]  # noqa: B023
            best = [best[came[x]] + t[came[x]][x] + row[x] for x in range(3)]
            back.append(came)
        tags = [max(range(3), key=lambda x: best[x] + (t[x][after] if after is not None else 0.0))]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]


class _Index(dict):
    """Word to number; notes the words that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Tagger:
    """Tags texts; remembers the scores of distinct words up to a bound."""

    def __init__(self, field: Field, max_words: int = MAX_WORDS):
        self.field, self.max_words, self.lead = field, max_words, field.leads()
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.index[""] = 0  # stands beyond the ends of a text and has no features
        self.scores, self.digits = np.zeros((4, 1 << 12, 3)), np.zeros(1 << 12, bool)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        while len(self.index) > len(self.digits):
            self.scores, self.digits = np.concatenate([self.scores, np.zeros_like(self.scores)], 1), np.concatenate([self.digits, np.zeros_like(self.digits)])
        first = len(self.index) - len(fresh)
        for at in range(0, len(fresh), 1 << 14):
            words = fresh[at : at + (1 << 14)]
            has = shapes(words)
            to = slice(first + at, first + at + len(words))
            for part in range(4):
                self.scores[part, to] = has @ self.field.part(part)
            self.digits[to] = has[:, SHAPES.index("digit")] > 0

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, two zeros before each text and behind the last, and the number of words of each."""
        if len(self.index) > self.max_words:
            self._clear()
        get, gap = self.index.__getitem__, np.zeros(2, np.int32)
        found, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found.append(gap)
            for words in _pieces(text):
                found.append(np.fromiter(map(get, words), np.int32, len(words)))
                sizes[k] += len(words)
        self._learn()
        return np.concatenate([*found, gap]), sizes

    def document_scores(self, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, langs: list[str | None], sources: list[str | None]) -> np.ndarray:
        """Scores that all words of a document get, by document."""
        digits = np.concatenate([[0], np.cumsum(self.digits[numbers])])
        shares = (digits[starts + sizes] - digits[starts]) / np.maximum(sizes, 1)
        each = [document_features(lang, source, share) for lang, source, share in zip(langs, sources, shares.tolist(), strict=True)]
        return np.array([self.field.of_document[features].sum(0) for features in each]).reshape(len(each), 3)

    def tags(self, texts: list[str], langs: list[str | None], sources: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, places, tags) of the words that aren't outside, for the texts that have some."""
        numbers, sizes = self.numbers(texts)
        starts = np.cumsum(sizes + 2) - sizes
        document = self.document_scores(numbers, starts, sizes, langs, sources)
        of = np.repeat(np.arange(len(texts)), sizes + 2)
        own, before, second, after = self.scores
        open_, kept = [], []
        for a in range(2, len(numbers) - 2, SCORE_WORDS):
            b = min(len(numbers) - 2, a + SCORE_WORDS)
            scores = own[numbers[a:b]] + before[numbers[a - 1 : b - 1]] + second[numbers[a - 2 : b - 2]] + after[numbers[a + 1 : b + 1]] + document[of[a:b]]
            at = np.flatnonzero(((scores[:, :1] - scores[:, 1:]) <= self.lead + 1e-9).any(1) & (numbers[a:b] > 0))
            open_.append(at + a)
            kept.append(scores[at])
        if not open_ or not sum(map(len, open_)):
            return
        places, scores = np.concatenate(open_), np.concatenate(kept)
        tags = np.empty(len(places), np.int64)
        for stretch in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > 1) + 1):
            before_, behind = numbers[places[stretch[0]] - 1], numbers[places[stretch[-1]] + 1]
            tags[stretch] = self.field.viterbi(scores[stretch], OUTSIDE if before_ else None, OUTSIDE if behind else None)
        some = tags != OUTSIDE
        places, tags = places[some], tags[some]
        texts_of = of[places]
        for text in np.unique(texts_of).tolist():
            a, b = np.searchsorted(texts_of, [text, text + 1])
            yield text, places[a:b] - starts[text], tags[a:b]

    def spans(self, texts: list[str], langs: list[str | None], sources: list[str | None], taken: list[list[Span]]) -> list[list[Span]]:
        """Tagged spans of each text, without quotes and the like, that don't overlap those of ``taken``."""
        found: list[list[Span]] = [[] for _ in texts]
        for text, places, tags in self.tags(texts, langs, sources):
            found[text] = _free(_values(texts[text], places.tolist(), tags.tolist()), taken[text])
        return found


def _values(text: str, places: list[int], tags: list[int]) -> list[Span]:
    """Spans of the tagged words: an inside word belongs to the word before it where that is tagged too."""
    wanted, found, last = dict(zip(places, tags, strict=True)), [], None
    for place, m in enumerate(WORD.finditer(text)):
        if place not in wanted:
            if place > places[-1]:
                break
            continue
        value = VALUE.match(m[0])
        start, end = m.start() + value.start(1), m.start() + value.end(1)
        if wanted[place] == INSIDE and found and last == place - 1:
            found[-1] = (*found[-1][:2], max(found[-1][2], end))
        elif end > start:
            found.append((start, KINDS.index(TAGGED), end))
        last = place
    return found


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``."""
    if not taken:
        return spans
    starts = [s for s, *_ in sorted(taken)]
    reach = np.maximum.accumulate([e for *_, e in sorted(taken)])  # the furthest end of those that start so early
    before = np.searchsorted(starts, [e for *_, e in spans])
    return [span for span, k in zip(spans, before.tolist(), strict=True) if k == 0 or reach[k - 1] <= span[0]]


def _pieces(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """The words of a text, those of about ``size`` characters at a time."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            gap = re.compile(r"[\x20\x09-\x0D]").search(text, end)
            end = gap.start() if gap else len(text)
        yield WORD.findall(text, start, end)
        start = end


# training


def _secret(rng: random.Random) -> str:
    """A made-up secret of one of a few forms."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, least, most: "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
    digits, upper = "0123456789", letters.upper()
    form = rng.randrange(6)
    if form == 0:
        return pick(letters + upper + digits, 20, 44)
    if form == 1:
        return pick(letters + upper + digits + "+/", 24, 60) + rng.choice(["", "=", "=="])
    if form == 2:
        return "AKIA" + pick(upper + digits, 16, 16)
    if form == 3:
        return pick("0123456789abcdef", 24, 64)
    if form == 4:
        return rng.choice(["sk_live_", "ghp_", "xoxb-", "pk-"]) + pick(letters + upper + digits, 20, 40)
    return pick(letters, 3, 6) + pick(upper + digits, 4, 6) + rng.choice("!@#%^&*_-") + pick(letters + upper + digits, 5, 9)


#: Words that a planted secret stands behind, and what stands round it; {} is the secret.
PLANTS = ("token = \"{}\"", "password: {}", "secret = '{}'", "the passwd is {}", "api_key={}", "key {}", "auth: Bearer {}", "pwd={}", "{}", "credential {} ,")


def planted(words: list[str], rng: random.Random) -> tuple[list[str], list[int]]:
    """``words`` with a secret in their midst, and the tags."""
    plant, secret = rng.choice(PLANTS), [_secret(rng)]
    if rng.random() < 0.15:  # a code in groups
        secret = ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(5)) for _ in range(rng.randint(4, 6))]
        plant = "secret: {}"
    if plant == "{}" and len(secret[0]) < 20:
        plant = "password: {}"
    ahead, behind = plant.split("{}")
    middle = (ahead + " ".join(secret) + behind).split(" ")
    first = ahead.count(" ")
    tags = [OUTSIDE if not first <= k < first + len(secret) else BEGIN if k == first else INSIDE for k in range(len(middle))]
    at = rng.randint(0, len(words))
    return words[:at] + middle + words[at:], [OUTSIDE] * at + tags + [OUTSIDE] * (len(words) - at)


def examples(rows: list[tuple[str, str | None, str | None]], seed: int = SEED) -> list[tuple[list[str], list[int], list[int]]]:
    """(words, tags, document features) of training windows, from (text, lang, source)."""
    rng, found = random.Random(seed), []
    for text, lang, source in rows:
        spots = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        if not spots:
            continue
        digit = sum(any(c.isdigit() for c in w) for *_, w in spots) / len(spots)
        features = document_features(lang, source, digit)
        starts = np.array([s for s, *_ in spots])
        tags = [OUTSIDE] * len(spots)
        for start, _, end in base_spans(text):
            # of an assignment the value, which is its last word
            first = int(np.searchsorted(starts, start, "right")) - 1
            last = int(np.searchsorted(starts, end - 1, "right")) - 1
            tags[last if first < last else first] = BEGIN
        hits = [k for k, tag in enumerate(tags) if tag]
        for k in hits[:20]:
            a, b = max(0, k - AROUND), k + AROUND
            found.append(([w for *_, w in spots[a:b]], tags[a:b], features))
        # what looks like a secret and is none: addresses, numbers
        odd = [k for k, (*_, w) in enumerate(spots) if not tags[k] and any(c.isdigit() or c == "@" for c in w)]
        for k in rng.sample(odd, min(3, len(odd))):
            a, b = max(0, k - AROUND), k + AROUND
            found.append(([w for *_, w in spots[a:b]], tags[a:b], features))
        k = rng.randrange(len(spots))
        a, b = max(0, k - AROUND), k + AROUND
        window, told = [w for *_, w in spots[a:b]], tags[a:b]
        found.append((window, told, features))
        if not any(told):
            found.append((*planted(window, rng), features))
    return found


def train(windows: list[tuple[list[str], list[int], list[int]]], steps: int = 160, rate: float = 0.25, penalty: float = 1e-3) -> Field:
    """The field of largest penalised likelihood, by Adam over all windows at once.

    Without windows every word is outside.
    """
    weights, transitions = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not windows:
        weights[SHAPES.index("constant"), OUTSIDE] = 1.0
        return Field(weights, transitions)
    many, turns, size = len(windows), max(len(w) for w, *_ in windows), len(SHAPES)
    index: dict[str, int] = {}
    at = np.zeros((turns + 3, many), np.int32)  # two before and one after
    tags, lengths, documents = np.zeros((turns, many), np.int64), np.array([len(w) for w, *_ in windows]), np.zeros((many, DOCUMENT_FEATURES))
    for n, (words, told, features) in enumerate(windows):
        for t, word in enumerate(words):
            at[t + 2, n] = index.setdefault(word, len(index) + 1)
        tags[: len(words), n] = told
        documents[n, features] = 1
    has = np.concatenate([np.zeros((1, size)), shapes(list(index))])
    inside = np.arange(turns)[:, None] < lengths[None, :]
    places = [at[2:-1], at[1:-2], at[:-3], at[3:]]
    truth = np.eye(3)[tags] * inside[:, :, None]
    pairs = inside[1:]
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:-1][pairs], tags[1:][pairs]), 1)
    moment, square = [np.zeros_like(weights), np.zeros_like(transitions)], [np.zeros_like(weights), np.zeros_like(transitions)]

    for step in range(1, steps + 1):
        field = Field(weights, transitions)
        scores = sum((has @ field.part(p))[places[p]] for p in range(4)) + (documents @ field.of_document)[None]
        likely, moves = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions)
        forward, backward, scale = np.empty((turns, many, 3)), np.ones((turns, many, 3)), np.ones((turns, many, 1))
        for t in range(turns):
            moved = likely[t] if t == 0 else (forward[t - 1] @ moves) * likely[t]
            scale[t] = moved.sum(1, keepdims=True)
            forward[t] = moved / scale[t]
        for t in range(turns - 2, -1, -1):
            moved = ((likely[t + 1] * backward[t + 1]) @ moves.T) / scale[t + 1]
            backward[t] = np.where(inside[t + 1][:, None], moved, 1)
        share = forward * backward * inside[:, :, None]
        wrong = (share - truth) / many
        later = likely[1:] * backward[1:] / scale[1:] * pairs[:, :, None]
        both = (forward[:-1].reshape(-1, 3).T @ later.reshape(-1, 3)) * moves
        slope = np.empty_like(weights)
        for p in range(4):
            by_word = np.stack([np.bincount(places[p].ravel(), wrong[:, :, x].ravel(), len(has)) for x in range(3)], 1)
            slope[p * size : (p + 1) * size] = has.T @ by_word
        slope[4 * size :] = documents.T @ wrong.sum(0)
        slopes = [slope + penalty * weights, (both - seen) / many + penalty * transitions]
        for k, value in enumerate((weights, transitions)):
            moment[k] = 0.9 * moment[k] + 0.1 * slopes[k]
            square[k] = 0.99 * square[k] + 0.01 * slopes[k] ** 2
            value -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, transitions)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Field:
    """A field from the ``rows`` texts of at most ``most_bytes`` bytes whose hash of doc_id and text is smallest, copies once."""
    picked = _picked(docs).where((F.octet_length("text") <= most_bytes) & (F.length("text") > 0))
    keyed = picked.select(F.xxhash64(F.lit(SEED), "doc_id", "text").alias("key"), "doc_id", "text", "lang", "source")
    # a range of hashes that should hold twice the rows, so that tasks send few; wider where copies leave too few
    width = 2 * rows / max(1, docs.count())
    while True:
        near = keyed if width >= 1 else keyed.where(F.col("key") < F.lit(int((width - 0.5) * 2**64)))
        each = near.groupBy("key").agg(F.min(F.struct("doc_id", "text", "lang", "source")).alias("d"))
        sample = each.orderBy("key").limit(rows).select("d.*").collect()
        if len(sample) == rows or width >= 1:
            return train(examples([(r["text"], r["lang"], r["source"]) for r in sample]))
        width *= 4


def _picked(docs: DataFrame) -> DataFrame:
    known = lambda name: F.col(name).cast("string").alias(name) if name in docs.columns else F.lit(None).cast("string").alias(name)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), known("lang"), known("source"))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Kinds are assign, access and hex of the fixed patterns, and crf of the field,
    which never takes a span away and adds none over another. Null and empty texts
    have no spans; a null language or source is one of its own; repeated rows are
    searched one by one; an empty table gives an empty result and leaves the field
    untrained; further columns are ignored. Whole texts are searched, however long,
    in pieces of about a million characters.
    """
    field = field or fit(docs)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in parts:
            for a, b, texts in text_slices(batch.column(1), 4 << 20):
                langs, sources = batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist()
                base = [base_spans(text) for text in texts]
                tagged = tagger.spans(texts, langs, sources, base)
                spans = [[{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in sorted(x + y)] for x, y in zip(base, tagged, strict=True)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, kind)], ["doc_id", "spans"])

    return _picked(docs).mapInArrow(search, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts of the fixed patterns' spans, the digest of these, and all spans as text; as ``find`` for the rest."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != TAGGED)
    return find(docs, field).select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
