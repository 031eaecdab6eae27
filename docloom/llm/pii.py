"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans of four kinds come from fixed patterns and checks. The model adds spans that the patterns miss (numbers
without a plus sign, addresses written out with "at" and "dot"): around what the patterns left over, a text is cut
into tokens, candidate segments of up to MAX_TOKENS tokens are scored by features of the whole span (digit counts,
grouping, separators, checksum, glued neighbours, words around it) and of neighbouring kinds, and a Viterbi pass over
bounded segments chooses boundaries and kinds jointly. The weights maximise the likelihood of generated, labelled
lines (`train`), found by the segment-level forward and backward sums; they are fitted by the driver from a fixed seed.
A decoded segment that touches a base span is not added: base spans stay as they are.

Windows grow and end with the text's own digits and signs; whole texts are read, and nothing is shuffled. A window of
any length is decoded piece by piece: of the path only what can still change is held, so memory doesn't grow with it.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, sliced

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
MAX_TOKENS = 14
AROUND = 48
#: Tokens of a stretch that are scored together, and how many tokens around a segment its features look at.
PIECE_TOKENS = 1024
NEIGHBOURS = 2

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|(?i:\bat\b\W{0,2}\s*\w+\s*\W{0,2}\bdot\b)")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
WORD = re.compile(r"[^\W\d_]+")
FORM = re.compile(r"w+(?:[._%+-]w+)*@w+(?:[.-]w+)*\.w+")

# Endings of host names, function words that are no part of an address, and words that announce a kind.
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk eu ch".split())
FUNCTION_WORDS = frozenset("a an the in on of to by is are was be it my your this that met look noon".split())
CUES = {
    "phone": frozenset("call phone tel telephone mobile cell fax ring dial whatsapp reach telefon handy mobil anruf portable llame appelez telefono".split()),
    "email": frozenset("mail email write contact address correo adresse".split()),
    "card": frozenset("card visa mastercard paid credit karte carte tarjeta".split()),
    "ip": frozenset("ip host server address node".split()),
    "other": frozenset("order version no total token isbn account invoice build population line serial".split()),
}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind as listed."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Window:
    """Tokens of a stretch of text, with what span features need."""

    def __init__(self, text: str, first: int, last: int):
        self.text, self.memo = text, {}
        self.spans = [m.span() for m in TOKEN.finditer(text, first, last)]
        self.tokens = [text[a:z] for a, z in self.spans]
        self.digits = [0]
        self.signs = [0]
        #: What a token can be in an address: "@", ".", "w" for letters or digits, nothing for a bracket, else itself.
        self.roles = []
        for t in self.tokens:
            low = t.lower()
            self.roles.append("@" if low in ("@", "at") else "." if low in (".", "dot") else "" if t in "()[]{}<>" else "w" if t.isalnum() else t)
            self.digits.append(self.digits[-1] + (len(t) if t[0] in "0123456789" else 0))
            self.signs.append(self.signs[-1] + (self.roles[-1] == "@"))

    def form(self, i: int, j: int) -> str:
        """Roles of the tokens [i, j), with a space where white space parts two words."""
        out = []
        for k in range(i, j):
            if k > i and self.roles[k] == "w" and self.roles[k - 1] == "w" and self.spans[k][0] > self.spans[k - 1][1]:
                out.append(" ")
            out.append(self.roles[k])
        return "".join(out)

    def goes_on(self, k: int, way: int) -> bool:
        """Whether the address would go on over token k: a sign or written-out dot with a word close behind."""
        if not (0 <= k < len(self.tokens) and 0 <= k + way < len(self.tokens)) or self.roles[k] not in ("@", ".", "-", "_", "+"):
            return False
        a, b = sorted((k, k + way))
        return self.roles[k + way] == "w" and (self.tokens[k].isalpha() or self.spans[b][0] == self.spans[a][1])

    def quad(self, i: int, j: int) -> bool:
        return j - i == 7 and all((self.roles[k] == ".") if (k - i) % 2 else self.tokens[k][0] in "0123456789" for k in range(i, j))

    def candidates(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int]]:
        """Segments [i, j) that could be personal data: digits enough, or an at sign inside, and a fit start and end; those
        that start at the tokens from `first` up to `last`."""
        n = len(self.tokens)
        for i in range(first, n if last is None else last):
            t = self.tokens[i]
            if not (t[0].isascii() and t[0].isalnum() or t in "+("):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                if j - i > 1 and self.spans[j - 1][0] - self.spans[j - 2][1] > 1 or "\n" in self.text[self.spans[i][0] : self.spans[j - 1][1]]:
                    break
                if self.tokens[j - 1][0].isalnum() and (self.digits[j] - self.digits[i] >= 7 or self.signs[j] - self.signs[i] == 1 and j - i >= 5 or self.quad(i, j)):
                    yield i, j

    def features(self, i: int, j: int) -> tuple[str, ...]:
        if (i, j) not in self.memo:
            self.memo[i, j] = self._features(i, j)
        return self.memo[i, j]

    def _features(self, i: int, j: int) -> tuple[str, ...]:
        a, z = self.spans[i][0], self.spans[j - 1][1]
        s, tokens = self.text[a:z], self.tokens[i:j]
        groups = [len(t) for t in tokens if t[0] in "0123456789"]
        letters = [t.lower() for t in tokens if t[0].isalpha()]
        n = sum(groups)
        seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s))))[:8]
        out = [f"n{min(n, 20)}", f"s{seps}", f"g{min(len(groups), 8)}", f"l{min(len(letters), 6)}"]
        if len(groups) <= 6:
            out.append("p" + "-".join(map(str, groups)))
        if 12 <= n <= 19 and not letters:
            digits = "".join(t for t in tokens if t[0] in "0123456789")
            out.append(f"luhn{luhn(digits)}")
        if len(groups) == 4 and not letters:
            out.append(f"ip{all(len(t) <= 3 and int(t) <= 255 for t in tokens if t[0] in '0123456789') and tokens.count('.') == 3}")
        if letters:
            bare = any(t.lower() == "at" and not (k and tokens[k - 1] in "([{<") for k, t in enumerate(tokens))
            form = bool(FORM.fullmatch(self.form(i, j)))
            out.append(f"form{form}bare{bare}end{letters[-1] in ENDINGS}")
            out.append(f"form{form}function{not FUNCTION_WORDS.isdisjoint(letters)}")
            out.append(f"form{form}on{self.goes_on(i - 1, -1)}{self.goes_on(j, 1)}")
        else:
            out.append(f"zero{s[0] == '0'}{n}")
            out.append(f"least{min(groups)}most{max(groups)}")
        before, after = self.text[a - 1 : a] if a else "", self.text[z : z + 1]
        out.append(f"glued{before.isalnum() or before in tuple('@_-.=+/')}{after.isalnum() or after in tuple('@_-=/')}")
        near = WORD.findall(self.text[max(0, a - 32) : a].lower())[-4:]
        cue = next((kind for w in reversed(near) for kind, words in CUES.items() if w in words), "none")
        out += [f"cue{cue}", f"cue{cue}l{bool(letters)}z{s[0] == '0'}s{seps}"]
        return tuple(out)


class Path:
    """The best labelled segmentations of the tokens read so far, one for each kind that the last segment can have.

    What all of them share is settled and given away, so a path holds no more than what is still open.
    """

    def __init__(self, model: SemiMarkov):
        self.steps = {(p, k): model.weights.get((p, f">{k}"), 0.0) for p in LABELS for k in LABELS}
        self.root = 0
        self.best: dict[int, dict[str, tuple[float, int, str]]] = {0: {"O": (0.0, -1, "")}}

    def step(self, j: int, segments: list[tuple[int, str, float]]) -> None:
        """Go on to token j by the segments (start, kind, score) that end there."""
        here: dict[str, tuple[float, int, str]] = {}
        for i, kind, score in segments:
            for prior, (total, _, _) in self.best[i].items():
                value = total + score + self.steps[prior, kind]
                if kind not in here or value > here[kind][0]:
                    here[kind] = (value, i, prior)
        self.best[j] = here

    def _back(self, at: int, kind: str) -> list[tuple[int, int, str]]:
        """Spans between the root and token `at`, in order."""
        out = []
        while at > self.root:
            _, i, prior = self.best[at][kind]
            if kind != "O":
                out.append((i, at, kind))
            at, kind = i, prior
        return out[::-1]

    def settle(self, last: int, open_from: int) -> list[tuple[int, int, str]]:
        """Spans that all segmentations share which can still go on, from any token of open_from..last."""
        heads = {(j, kind) for j in range(max(self.root, open_from), last + 1) for kind in self.best[j]}
        while len(heads) > 1:
            head = max(heads)
            if head[0] <= self.root:
                return []
            heads.remove(head)
            _, i, prior = self.best[head[0]][head[1]]
            heads.add((i, prior))
        (at, kind), = heads
        out = self._back(at, kind)
        self.best[at] = {kind: self.best[at][kind]}
        for j in range(self.root, at):
            del self.best[j]
        self.root = at
        return out

    def finish(self) -> list[tuple[int, int, str]]:
        """Spans of the best segmentation of all that was read."""
        last = max(self.best)
        return self._back(last, max(self.best[last], key=lambda k: self.best[last][k][0]))


class SemiMarkov:
    """Weights of whole-span features by kind, and of neighbouring kinds."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def segments(self, w: Window) -> list[list[tuple[int, str, float]]]:
        """For each end: (start, kind, score) of its segments; single tokens may be outside any span."""
        ends: list[list[tuple[int, str, float]]] = [[] for _ in range(len(w.tokens) + 1)]
        for j in range(1, len(w.tokens) + 1):
            ends[j].append((j - 1, "O", 0.0))
        for i, j in w.candidates():
            features = w.features(i, j)
            for kind in KINDS:
                ends[j].append((i, kind, self.score(kind, features)))
        return ends

    def score(self, kind: str, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return get((kind, ""), 0.0) + sum(get((kind, f), 0.0) for f in features)

    def decode(self, w: Window) -> list[tuple[int, int, str]]:
        """The best segmentation's spans (token offsets)."""
        path = Path(self)
        ends = self.segments(w)
        for j in range(1, len(w.tokens) + 1):
            path.step(j, ends[j])
        return path.finish()

    def decode_text(self, text: str, first: int, last: int) -> Iterator[Span]:
        """Spans (text offsets) of the best segmentation of a stretch of any length, piece by piece.

        A piece's segments are scored on its tokens with enough of those before and behind; only the path goes on to the
        next piece, and of it only what is still open.
        """
        path, tokens, base = Path(self), [], 0  # places of the tokens from number `base` on
        found = (m.span() for m in TOKEN.finditer(text, first, last))
        places: dict[int, tuple[int, int]] = {}  # of tokens that spans still to come may begin or end with
        ends: dict[int, list[tuple[int, str, float]]] = {}
        at = 0
        while True:
            tokens += itertools.islice(found, max(0, at + PIECE_TOKENS + MAX_TOKENS + NEIGHBOURS - base - len(tokens)))
            upto = min(at + PIECE_TOKENS, base + len(tokens))
            if upto == at:
                break
            w = Window(text, tokens[0][0], tokens[-1][1])
            for i, j in w.candidates(at - base, upto - base):
                places[base + i], places[base + j - 1] = tokens[i], tokens[j - 1]
                features = w.features(i, j)
                ends.setdefault(base + j, []).extend((base + i, kind, self.score(kind, features)) for kind in KINDS)
            for j in range(at + 1, upto + 1):
                path.step(j, [(j - 1, "O", 0.0), *ends.pop(j, ())])
            for i, j, kind in path.settle(upto, upto + 1 - MAX_TOKENS):
                yield places[i][0], places[j - 1][1], kind
            places = {k: v for k, v in places.items() if k >= path.root}
            at = upto
            drop = max(0, at - NEIGHBOURS - base)
            del tokens[:drop]
            base += drop
        for i, j, kind in path.finish():
            yield places[i][0], places[j - 1][1], kind

    def learn(self, w: Window, gold: list[tuple[int, int, str]], rate: float) -> None:
        """One step up the log-likelihood of `gold`: its counts less the expected counts over all segmentations."""
        n, ends = len(w.tokens), self.segments(w)
        step = {(p, k): self.weights.get((p, f">{k}"), 0.0) for p in LABELS for k in LABELS}
        forward = [{"O": 0.0}] + [defaultdict(lambda: -math.inf) for _ in range(n)]

        def add(a: float, b: float) -> float:
            if a == -math.inf:
                return b
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        for j in range(1, n + 1):
            for i, kind, score in ends[j]:
                for prior, total in forward[i].items():
                    forward[j][kind] = add(forward[j][kind], total + score + step[prior, kind])
        backward = [defaultdict(lambda: -math.inf) for _ in range(n)] + [{k: 0.0 for k in LABELS}]
        whole = -math.inf
        for v in forward[n].values():
            whole = add(whole, v)
        change: dict[tuple[str, str], float] = defaultdict(float)
        for j in range(n, 0, -1):
            for i, kind, score in ends[j]:
                if kind not in backward[j]:
                    continue
                for prior in forward[i]:
                    value = score + step[prior, kind] + backward[j][kind]
                    backward[i][prior] = add(backward[i][prior], value)
                    p = math.exp(min(0.0, forward[i][prior] + value - whole))
                    if p > 1e-4:
                        change[prior, f">{kind}"] -= p
                        if kind != "O":
                            change[kind, ""] -= p
                            for f in w.features(i, j):
                                change[kind, f] -= p
        at, prior, inside = 0, "O", {i: (j, k) for i, j, k in gold}
        while at < n:
            j, kind = inside.get(at, (at + 1, "O"))
            change[prior, f">{kind}"] += 1
            if kind != "O":
                change[kind, ""] += 1
                for f in w.features(at, j):
                    change[kind, f] += 1
            at, prior = j, kind
        for key, d in change.items():
            self.weights[key] += rate * d


def labelled_line(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated line with at most one span, or with a look-alike that is none."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice(("an", "er", "the", "on", "re", "st", "in", "ou", "ti", "le", "de")) for _ in range(rng.randint(2, 4)))

    def part() -> str:
        return rng.choice((word(), word(), word() + digits(2)))

    def cue_of(*kinds: str) -> str:
        kind = rng.choice(kinds)
        return rng.choice(sorted(CUES[kind])) + rng.choice(("", "", " me on", " us at", " number is", " him under", " is")) if kind else ""

    area, middle, last, kind = digits(3), digits(3), digits(4), None
    ending = rng.choice(sorted(ENDINGS))
    shape = rng.randrange(20)
    if shape < 4:
        body = rng.choice((f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"1-{area}-{middle}-{last}", f"({area}) {middle} {last}", f"{area} {middle} {last}"))
        cue = cue_of("", "phone")
        kind = "phone" if cue or not re.fullmatch(r"[0-9 ]+", body) else None
    elif shape < 7:
        body = rng.choice((
            f"0{digits(4)} {digits(6)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(2)} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"0{digits(3)}-{digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            f"{digits(2)} {digits(3)} {digits(2)} {digits(2)}", f"{digits(3)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(9)}",
        ))
        cue = cue_of("phone", "phone", "phone", "", "other")
        kind = "phone" if any(w in CUES["phone"] for w in cue.split()) else None
    elif shape < 10:
        at, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" (at) ", " (dot) "), ("@", " . "), (" @ ", "."), (" {at} ", " {dot} "), ("(at)", "(dot)")))
        body, kind = f"{part()}{rng.choice(('', '', dot + part(), '_' + part(), '-' + part()))}{at}{word()}{rng.choice(('', '', dot + word()))}{dot}{ending}", "email"
        cue = cue_of("", "email")
    elif shape == 10:
        body, kind, cue = " . ".join(str(rng.randint(0, rng.choice((9, 99, 255)))) for _ in range(4)), "ip", cue_of("ip")
    elif shape == 11:
        stem = digits(15)
        whole = next(stem + d for d in "0123456789" if luhn(stem + d))
        body, kind, cue = ".".join(whole[k : k + 4] for k in range(0, 16, 4)), "card", cue_of("", "card")
    else:
        cue = cue_of("", "other")
        body = rng.choice((
            digits(rng.randint(7, 20)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(1)}.{digits(2)}.{digits(5)}", f"{digits(5)}.{digits(4)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))), f"{digits(4)}-{digits(4)}", f"{digits(3)},{digits(3)},{digits(3)}", f"look at {word()} {word()}", f"{word()} at the {word()}. {word().title()}",
            f"{digits(2)}:{digits(2)}:{digits(2)}.{digits(3)}", f"{digits(8)}-{digits(4)}-{digits(4)}", f"@{word()}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(1)}.{digits(1)}.{digits(1)}-{digits(6)}", f"{digits(2)} {digits(3)} {digits(4)} {digits(2)}",
            ".".join(digits(4) for _ in range(4)), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"00{digits(8)}", f"{digits(1)} {digits(3)} {digits(3)}", f"{digits(4)} {digits(6)}", f"{digits(2)} {digits(3)} 000",
            f"{word()} at the dot {ending} {word()}", f"{word()} at {word()} dot by {word()}", f"{word()} {digits(2)} at {digits(1)} dot {digits(2)} in the {word()}", f"{word()} at {word()} dot {word()} {word()}", " . ".join(digits(3) for _ in range(3)),
        ))
    head = " ".join(word() for _ in range(rng.randint(0, 4))) + (f" {cue}" if cue else "") + rng.choice((" ", ": ", " = ", " "))
    tail = rng.choice((" ", ". ", ", ", " ### ")) + " ".join(word() for _ in range(rng.randint(0, 3)))
    return head + body + tail, [(len(head), len(head) + len(body), kind)] if kind else []


@cache
def train(lines: int = 2400, epochs: int = 4, seed: int = 11) -> SemiMarkov:
    """Fit the weights to generated lines; the same arguments give the same weights."""
    rng, model, examples = random.Random(seed), SemiMarkov(), []
    for _ in range(lines):
        text, gold = labelled_line(rng)
        w = Window(text, 0, len(text))
        starts, ends = {a: k for k, (a, _) in enumerate(w.spans)}, {z: k + 1 for k, (_, z) in enumerate(w.spans)}
        spans = [(starts[a], ends[z], kind) for a, z, kind in gold if a in starts and z in ends]
        known = set(w.candidates())
        examples.append((w, [s for s in spans if s[:2] in known]))
    for epoch in range(epochs):
        rng.shuffle(examples)
        for w, gold in examples:
            model.learn(w, gold, 0.3 / (1 + epoch))
    model.weights = dict(model.weights)
    return model


def added_spans(text: str, base: list[Span], model: SemiMarkov) -> list[Span]:
    """Spans that the model finds around what the base spans leave over."""
    taken = sorted((a, z) for a, z, _ in base)
    regions: list[list[int]] = []
    k = 0
    reach = 0
    for m in TRIGGER.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][0] <= at:
            reach = max(reach, taken[k][1])
            k += 1
        if at < reach:
            continue
        a, z = max(0, at - AROUND), min(len(text), m.end() + AROUND)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], z)
        else:
            regions.append([a, z])
    starts = [p for p, _ in taken]
    ends = list(itertools.accumulate((q for _, q in taken), max))
    out = []
    for a, z in regions:
        # Begin and end at white space, so that no token is cut.
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        for x, y, kind in model.decode_text(text, a, z):
            before = bisect_left(starts, y)  # base spans that begin before the end of this one
            if not (before and ends[before - 1] > x) and (not out or x >= out[-1][1]):
                out.append((x, y, kind))
    return out


def find_spans(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind as listed."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """id, base counts n_<kind>, base_sha256 and spans of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [find_spans(t.as_py(), shared.value) for t in b.column(1)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(every) for _, every in found], pa.string())], names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def mask(docs: DataFrame, text_col: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """`docs` with every span of its text replaced by its kind in angle brackets; all other columns stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def cover(text: str | None) -> str | None:
        _, spans = find_spans(text, shared.value)
        if not spans:
            return text
        out, at = [], 0
        for a, z, kind in spans:
            if z <= at:  # inside a span that is covered already
                continue
            out += [text[at:a], f"<{kind}>"] if a >= at else []
            at = z
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def covered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(cover).astype(object)

    return docs.withColumn(text_col, covered(F.col(text_col)))
