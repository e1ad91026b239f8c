"""Personal data: four base patterns, and spans from a linear-chain conditional random field.

The field has word-shape features and is trained from a small labelled table; numpy decodes batches of
whole texts by Viterbi. It adds what the patterns don't match, such as spelled-out addresses, local phone
numbers and card numbers with an expiry date behind them; base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.common import batch, released, slices, utf8

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: What may stand between the groups of digits of a span that the field decodes, and how far beside it groups count.
GROUP = re.compile(r"(?<![0-9])[0-9]+")
CARD_GAP = re.compile(r"[\s./-]{1,3}")
IP_GAP = re.compile(r"[\s\[(]{0,2}(?:\.|dot)[\s\])]{0,2}")
REACH = 40

Span = tuple[int, int, int]  #: start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each at sign to both sides, so that long runs without one cost nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, 0, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start and kind."""
    out = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 2 * 19 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# The labelled table: tokens between marks [kind ...] are that kind's, all others are not personal data.
LABELLED = """
call me at [phone 555-201-8890] after six
phone : [phone (212) 555-0147] or leave a note
tel [phone 020 7946 0958] for the office
my number is [phone 415 555 2671] thanks
mobile [phone 0171-5550199] abends
please ring [phone (030) 5550 1234] today
fax [phone 617-555-0123] and mail it
reach us on [phone 800.555.0199] any time
call [phone +44 20 7946 0018] now
tel : [phone 01 55 50 12 34] svp
write to [email jane dot doe at example dot com] soon
mail [email bob [at] example [dot] org] please
my mail is [email maria at mail dot example dot net] thanks
contact [email sam (at) example (dot) com] for more
e-mail : [email k.lee AT example.com] or call
email [email info at example.org] bitte
send it to [email joe_b at web dot example dot de] today
write [email ann@example.com] or
mail [email tom at shop dot com] please
ask [email rita at work dot org] about it
[email paul at sea dot net] knows more
my email [email eve at lab dot de] works
reach [email lia (at) web (dot) com] now
text [phone 212 555 0183] later
line [phone 303-555-0121] is free
host [ip 10.0.0.12] is down
server at [ip 192.168.1.77] port 80
ping [ip 172.16.254.1] failed
address [ip 203.0.113.9] blocked
card [card 4111 1111 1111 1111] exp 12/27
visa [card 5500-0000-0000-0004] was charged
pay with [card 340000000000009] please
the meeting is at 10 in room 12
in 2024 we sold 1200 of them at 15 each
version 1.2.3 came out on 2021-03-04
chapter 12.3 and page 145 of 300
order 88213 has 3 items at 20 dollars
see figure 4-2 and table 10-11 below
the score was 3-2 at half time
he looked at the dot on the map
look at example 3 dot points are fine
meet at noon dot your notes
pages 100-120 and 200-210
from 1990 to 2005 about 450 000 people
id 4465758382889437 in the log
build 20240301 passed 450 tests
token = 24be64439e3e49cf46b2d7c90f3602a3
license 2.0 section 4.1.2
isbn 978-3-16-148410-0 in print
at 12:30 on 2020-01-02 it rained
x1 = 0.577 and y2 = 1.414
ratio 16:9 at 60 hz
"""
WORDS = ("at", "dot", "call", "phone", "tel", "mobile", "ring", "fax", "number", "mail", "email", "card", "visa", "host", "ip", "server", "com", "org", "net", "de", "example", "isbn", "id", "version", "page", "pages")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
FEATURES = 4096
#: Tokens whose emissions a worker holds at once (360 bytes each while they are summed); sequences may be longer.
TOGETHER = 256 * 400
#: Tokens of a chunk of a text, and those before it from which its first scores come.
CHUNK, WARM = 128, 24


def shape(token: str, gap: bool) -> list[str]:
    if token.isdigit():
        kind = f"d{min(len(token), 9)}"
    elif token.isascii() and token.isalpha():
        low = token.lower()
        kind = f"w={low}" if low in WORDS else ("X" if token.isupper() else "Xx" if token[0].isupper() else "x") + str(min(len(token), 4) // 2)
    else:
        kind = f"p={token}" if token.isascii() else "p=other"
    return [kind, f"{kind}|{int(gap)}"]


def slot(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % FEATURES


@cache
def slots_of(name: str) -> int:
    return slot(name)


def encode(tokens: list[tuple[str, bool]]) -> np.ndarray:
    """(tokens, features): the token's shape, and its neighbours' up to two places away."""
    pad = ["^", "^"]
    n = len(tokens)
    out = np.zeros((n, 9), np.int32)
    near = [pad, pad, pad, *(shape(*t) for t in tokens[:2])]
    near += [pad] * (5 - len(near))
    for i in range(n):
        near = [*near[1:], shape(*tokens[i + 2]) if i + 2 < n else pad]
        names = [f"{d}:{x[0]}" for d, x in zip((-2, -1, 0, 1, 2), near, strict=True)]
        names += [f"g:{near[2][1]}", f"b:{near[1][0]}>{near[2][1]}", f"a:{near[2][1]}>{near[3][1]}", f"t:{near[1][0]}>{near[2][0]}>{near[3][0]}"]
        out[i] = [slots_of(x) for x in names]
    return out


#: Kinds of tokens by number: the edge of a text, digits by their number, known words, words by case and length, marks.
KIND_NAMES = ["^", *(f"d{n}" for n in range(1, 10)), *(f"w={w}" for w in WORDS), *(f"{c}{n}" for c in ("X", "Xx", "x") for n in range(3)), *(f"p={chr(c)}" for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()), "p=other"]
KIND = {name: k for k, name in enumerate(KIND_NAMES)}
SPACE, LETTER, DIGIT, MARK = range(4)
#: The class of each character up to the last white space there is.
CLASSES = np.array([DIGIT if 48 <= c < 58 else LETTER if c < 128 and chr(c).isalpha() else SPACE if chr(c).isspace() else MARK for c in range(0x3001)], np.int8)
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hash(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of lower-case words, of their first seven letters."""
    out = length.astype(np.uint64)
    for k in range(7):
        at = np.minimum(start + k, len(codes) - 1)
        out = out * HASH_BASE + np.where(k < length, codes[at] | 32, 0).astype(np.uint64)
    return out


@cache
def known_words() -> tuple[np.ndarray, np.ndarray]:
    codes = [np.array([ord(c) for c in w], np.uint32) for w in WORDS]
    hashes = np.array([word_hash(c, np.array([0]), np.array([len(c)]))[0] for c in codes])
    order = np.argsort(hashes)
    return hashes[order], np.array([KIND[f"w={w}"] for w in WORDS])[order]


def tokens_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, kind, gap) of every token of all texts; places are code points of the text."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(codes < len(CLASSES), CLASSES[np.minimum(codes, len(CLASSES) - 1)], MARK)
    opens = np.ones(len(codes), bool)
    opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
    at = np.flatnonzero(opens)
    end = np.append(at[1:], len(codes))
    real = kind[at] != SPACE
    start, end = at[real], end[real]
    length, what = end - start, kind[start]
    upper = np.concatenate(([0], np.cumsum((codes >= 65) & (codes <= 90))))
    capitals = upper[end] - upper[start]
    case = np.where(capitals == length, 0, np.where((codes[start] >= 65) & (codes[start] <= 90), 1, 2))
    out = KIND["X0"] + 3 * case + np.minimum(length, 4) // 2
    hashes, names = known_words()
    letters = what == LETTER
    own = word_hash(codes, start[letters], length[letters])
    place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    short = (hashes[place] == own) & (length[letters] <= 7)
    out[letters] = np.where(short, names[place], out[letters])
    out[what == DIGIT] = np.minimum(length[what == DIGIT], 9)  # kinds 1 to 9
    marks = np.full(128, KIND["p=other"])
    for c in range(128):
        marks[c] = KIND.get(f"p={chr(c)}", KIND["p=other"])
    own = codes[start[what == MARK]]
    out[what == MARK] = np.where(own < 128, marks[np.minimum(own, 127)], KIND["p=other"])
    text = np.searchsorted(begin, start, side="right") - 1
    gap = start > np.maximum(np.concatenate(([0], end[:-1])), begin[text])
    return text, start - begin[text], end - begin[text], out, gap


class Slots:
    """Feature slots by the numbers of kinds; each combination is named once, when it first comes up."""

    def __init__(self) -> None:
        n = len(KIND_NAMES)
        self.n = n
        self.single = np.array([[slots_of(f"{d}:{x}") for x in KIND_NAMES] for d in (-2, -1, 0, 1, 2)], np.int32)
        self.with_gap = ["^" if k == 0 else f"{x}|{g}" for k, x in enumerate(KIND_NAMES) for g in (0, 1)]
        self.gapped = np.array([slots_of(f"g:{x}") for x in self.with_gap], np.int32)
        self.before, self.after, self.three = (np.full(m, -1, np.int32) for m in (n * 2 * n, 4 * n * n, n**3))

    def looked_up(self, table: np.ndarray, codes: np.ndarray, name) -> np.ndarray:
        out = table[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                table[c] = slot(name(c))
            out = table[codes]
        return out

    def of(self, text: np.ndarray, kind: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """(tokens, features), as ``encode`` has them for each text."""
        n, names = self.n, KIND_NAMES
        away = []
        for d in (-2, -1, 1, 2):
            own = np.zeros(len(kind), np.int64)
            here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            own[here] = np.where(text[here] == text[there], kind[there], 0)
            away.append(own)
        far, last, next_, further = away
        g = kind * 2 + gap
        next_g = next_ * 2 + np.where(next_ > 0, np.append(gap[1:], False), False)
        return np.stack([
            self.single[0][far], self.single[1][last], self.single[2][kind], self.single[3][next_], self.single[4][further], self.gapped[g],
            self.looked_up(self.before, last * 2 * n + g, lambda c: f"b:{names[c // (2 * n)]}>{self.with_gap[c % (2 * n)]}"),
            self.looked_up(self.after, g * 2 * n + next_g, lambda c: f"a:{self.with_gap[c // (2 * n)]}>{self.with_gap[c % (2 * n)]}"),
            self.looked_up(self.three, (last * n + kind) * n + next_, lambda c: f"t:{names[c // n // n]}>{names[c // n % n]}>{names[c % n]}"),
        ], axis=1)


@cache
def slots() -> Slots:
    return Slots()


class Crf:
    """Labels 0 (none) and 1..4 (KINDS); emissions are sums of feature weights."""

    LABELS = 1 + len(KINDS)

    def __init__(self):
        self.weights = np.zeros((FEATURES, self.LABELS))
        self.moves = np.zeros((self.LABELS, self.LABELS))

    @staticmethod
    def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), length.max(), 9), np.int32)
        for k, s in enumerate(sequences):
            out[k, : len(s)] = s
        return out, length

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.5, ridge: float = 2e-3) -> Crf:
        """Maximum likelihood by adaptive gradient steps; forward and backward run over the whole table at once."""
        x, length = self.padded(sequences)
        n, t, _ = x.shape
        y = np.zeros((n, t), int)
        for k, own in enumerate(labels):
            y[k, : len(own)] = own
        on = np.arange(t)[None, :] < length[:, None]
        truth = np.eye(self.LABELS)[y] * on[..., None]
        pairs = on[:, 1:] & on[:, :-1]
        moved = np.einsum("nti,ntj->ij", truth[:, :-1] * pairs[..., None], truth[:, 1:] * pairs[..., None])
        seen_w, seen_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(rounds):
            e = self.weights[x].sum(axis=2)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, t):
                step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.moves[None], axis=1) + e[:, i]
                alpha[:, i] = np.where(on[:, i, None], step, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                step = np.logaddexp.reduce(self.moves[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                beta[:, i] = np.where(on[:, i + 1, None], step, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            at = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
            joint = np.exp(alpha[:, :-1, :, None] + self.moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
            grad_w = -ridge * self.weights
            np.add.at(grad_w, x.reshape(-1, 9), np.repeat((truth - at).reshape(-1, 1, self.LABELS), 9, axis=1))
            grad_m = moved - joint.sum(axis=(0, 1)) - ridge * self.moves
            seen_w += grad_w**2
            seen_m += grad_m**2
            self.weights += rate * grad_w / np.sqrt(seen_w)
            self.moves += rate * grad_m / np.sqrt(seen_m)
        return self

    def labels(self, text: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The best path of each text (tokens of one text are together): Viterbi over chunks of all texts at once.

        A chunk's scores at its beginning come from the WARM tokens before it. Where they differ from those that the chunk
        before ends with, by more than rounding and a constant, it runs again from there, until all agree; so the paths are
        those of whole texts. Each chunk is traced back from every label at its end, and the texts' last chunks say from which.
        """
        e = np.empty((len(text), self.LABELS))
        for at in range(0, len(text), TOGETHER):
            e[at : at + TOGETHER] = self.weights[features[at : at + TOGETHER]].sum(axis=1)
        opens = np.flatnonzero(np.diff(text, prepend=-1))
        size = np.diff(opens, append=len(text))
        count = -(-size // CHUNK)
        of = np.repeat(np.arange(len(opens)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = opens[of] + nth * CHUNK
        length = np.minimum(CHUNK, opens[of] + size[of] - start)
        entry = np.zeros((len(of), self.LABELS))
        for back in range(WARM, 0, -1):
            at = start - back
            inside = at >= opens[of]
            before = (entry[:, :, None] + self.moves).max(axis=1) + e[np.maximum(at, 0)]
            entry = np.where((at == opens[of])[:, None], e[np.maximum(at, 0)], np.where(inside[:, None], before, entry))
        level = lambda x: x - x.max(axis=1, keepdims=True)
        entry, leave = level(entry), np.empty_like(entry)
        back = np.zeros((len(of), CHUNK, self.LABELS), np.int8)
        todo = np.arange(len(of))
        while len(todo):
            best, first = entry[todo], nth[todo] == 0
            for i in range(int(length[todo].max())):
                step = best[:, :, None] + self.moves
                own = e[np.minimum(start[todo] + i, len(e) - 1)]
                after = step.max(axis=1) + own
                if i == 0:
                    after = np.where(first[:, None], own, after)
                back[todo, i] = step.argmax(axis=1)
                best = np.where((i < length[todo])[:, None], after, best)
            leave[todo] = level(best)
            wrong = np.flatnonzero((nth[1:] > 0) & (np.abs(entry[1:] - leave[:-1]).max(axis=1) > 1e-9)) + 1
            entry[wrong] = leave[wrong - 1]
            todo = wrong
        came = np.broadcast_to(np.arange(self.LABELS, dtype=np.int8), leave.shape)
        path = np.zeros((len(of), CHUNK, self.LABELS), np.int8)
        for i in range(CHUNK - 1, -1, -1):
            path[:, i] = came
            came = np.where((i < length)[:, None], np.take_along_axis(back[:, i], came, axis=1), came)
        end, from_last = leave.argmax(axis=1), np.repeat(count, count) - 1 - nth
        for k in range(1, int(count.max())):
            own = np.flatnonzero(from_last == k)
            end[own] = came[own + 1, end[own + 1]]
        chosen = np.take_along_axis(path, end[:, None, None], axis=2)[:, :, 0]
        return chosen[np.arange(CHUNK)[None, :] < length[:, None]]

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over whole sequences of features, those of like length together; emissions are summed for some places at a time."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and stop - at < 256 and (stop + 1 - at) * len(sequences[order[stop]]) <= TOGETHER:
                stop += 1
            own, at = order[at:stop], stop
            x, length = self.padded([sequences[k] for k in own])
            n, t, _ = x.shape
            block = max(1, TOGETHER // n)
            back = np.zeros((n, t, self.LABELS), np.int8)
            for first in range(0, t, block):
                e = self.weights[x[:, first : first + block]].sum(axis=2)
                if first == 0:
                    best = e[:, 0].copy()
                for i in range(max(1, first), min(t, first + block)):
                    step = best[:, :, None] + self.moves[None]
                    back[:, i] = step.argmax(axis=1)
                    best = np.where((i < length)[:, None], step.max(axis=1) + e[:, i - first], best)
            path = np.zeros((n, t), np.int8)
            state = best.argmax(axis=1)
            for i in range(t - 1, -1, -1):
                path[:, i] = state
                state = np.where(i < length, back[np.arange(n), i, state], state)
            for k, row, m in zip(own, path, length, strict=True):
                out[k] = row[:m]
        return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, int, int, bool]]:
    out, last = [], start
    for m in TOKEN.finditer(text, start, end):
        out.append((m[0], m.start(), m.end(), m.start() > last))
        last = m.end()
    return out


def labelled_table() -> tuple[list[np.ndarray], list[np.ndarray]]:
    sequences, labels = [], []
    for line in LABELLED.strip().splitlines():
        text, spans = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone) (?:[^\[\]]|\[[a-z]+\])*\])", line):
            m = re.match(r"\[(email|ip|card|phone) (.*)\]\Z", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), 1 + KINDS.index(m[1])))
                text += m[2]
            else:
                text += part
        tokens = tokens_of(text, 0, len(text))
        sequences.append(encode([(t, gap) for t, _, _, gap in tokens]))
        labels.append(np.array([next((k for s, e, k in spans if s <= a < e), 0) for _, a, _, _ in tokens]))
    return sequences, labels


@cache
def trained() -> Crf:
    return Crf().fit(*labelled_table())


def plausible(kind: int, text: str) -> bool:
    digits = len(NOT_DIGIT.sub("", text))
    if kind == 0:
        return digits < len(text) // 2 and bool(re.search(r"(?i)@|\bat\b", text)) and bool(re.search(r"(?i)\.|\bdot\b", text))
    return 9 <= digits <= 15 and len(text) <= 24


def number_spans(kind: int, text: str, start: int, end: int) -> list[Span]:
    """Addresses or card numbers that pass their base test, made of whole groups of digits at or beside a decoded span.

    The base patterns take the longest match only. Here groups may be left out on either side, such as an expiry
    date, or added where the field has missed them. Of overlapping ones, that which covers most of the decoded
    span with the least beside it stays.
    """
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    groups = [(m.start(), m.end()) for m in GROUP.finditer(text, low, high)]
    if groups and groups[-1][1] == high and text[high : high + 1].isdigit():
        groups.pop()
    joined = [bool((IP_GAP if kind == 1 else CARD_GAP).fullmatch(text, p[1], q[0])) for p, q in zip(groups, groups[1:], strict=False)]
    ranked = []
    for i, (s, _) in enumerate(groups):
        digits = ""
        for j in range(i, len(groups)):
            if j > i and not joined[j - 1]:
                break
            part = text[slice(*groups[j])]
            digits += part
            if kind == 1 and (len(p := part.lstrip("0")) > 3 or int(p or 0) > 255 or j > i + 3) or kind == 2 and len(digits) > 19:
                break
            e = groups[j][1]
            inside = min(e, end) - max(s, start)
            if inside > 0 and (j == i + 3 if kind == 1 else len(digits) >= 12 and luhn(digits)):
                ranked.append((-inside, e - s, s, e))
    out: list[Span] = []
    for _, _, s, e in sorted(ranked):
        if all(e <= x[0] or x[2] <= s for x in out):
            out.append((s, kind, e))
    return sorted(out)


def find(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the field adds) of each text; the field decodes every token of every text."""
    for first, last in slices(np.array([len(t) for t in texts], np.int64)):
        yield from found_in(texts[first:last])


def found_in(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    crf = trained()
    of, starts, ends, kind, gap = tokens_in(texts)
    label = crf.labels(of, slots().of(of, kind, gap)) if len(of) else np.empty(0, np.int8)
    turn = np.ones(len(of), bool)
    turn[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
    runs = np.flatnonzero(turn)
    stops = np.append(runs[1:], len(of))
    more: dict[int, list[Span]] = {}
    for a, b in zip(runs[label[runs] > 0].tolist(), stops[label[runs] > 0].tolist(), strict=True):
        more.setdefault(int(of[a]), []).append((int(starts[a]), int(label[a]) - 1, int(ends[b - 1])))
    for k, text in enumerate(texts):
        base = base_spans(text)
        added: list[Span] = []
        tested = [x for s in more.get(k, ()) if s[1] in (1, 2) for x in number_spans(s[1], text, s[0], s[2])]
        for s in (*tested, *(s for s in more.get(k, ()) if s[1] in (0, 3) and plausible(s[1], text[s[0] : s[2]]))):
            if all(s[2] <= b[0] or b[2] <= s[0] for b in (*base, *added)):
                added.append(s)
        yield base, added


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("n_added", pa.int64())])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: base and all spans as kind:start:end in code points, and base counts by kind.

    Null texts count as empty; an empty text has no spans, and an empty table gives no rows. Repeated rows are each answered. Texts of any length are
    decoded whole, in memory in proportion to one text. Further columns aren't read. Spans that the field adds reach over at most REACH tokens beside the
    base's and 24 characters; longer ones stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = whole.slice(at, 500)
                out: list[list] = [[] for _ in FOUND.names[1:]]
                for base, added in find([t.decode() for t in utf8(rows.column(1))]):
                    count = [sum(k == want for _, k, _ in base) for want in range(4)]
                    for column, value in zip(out, (written(base), written(sorted(base + added)), *count, len(added)), strict=True):
                        column.append(value)
                yield batch(FOUND, doc_id=rows.column(0), **dict(zip(FOUND.names[1:], out, strict=True)))
        released()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or overlapping spans together, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(texts: list[str]) -> Iterator[str]:
    """The texts with all spans replaced, one for each, whole at any length; an empty one stays empty."""
    for text, (base, added) in zip(texts, find(texts), strict=True):
        yield redacted(text, base + added) if base or added else text
