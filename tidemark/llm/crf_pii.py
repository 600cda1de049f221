"""Personal data by base patterns and a linear-chain conditional random field.

Base patterns find emails, IP addresses, card numbers and phone numbers; those that fail their checks are
dropped. A conditional random field over words finds more: addresses that are spelled out, numbers in other
notations, and secrets such as keys and tokens. It sees of each word, and of two words on either side, the
word itself where the labelled table knows it, its shape, and a coarse class of its characters. It is trained on
a small labelled table, made from the lines below with other values in each row, so that it learns forms and
neighbours and no values. What it marks must pass the arithmetic of its kind (four numbers up to 255, a Luhn
sum, a count of digits) and never touches a base span.

Emissions are looked up for all words of a slice at once. A word that lies in no run of words whose evidence could
pay for entering and leaving a span is outside on every best path, so Viterbi runs, in padded numpy batches, on the
pieces between such words; this is exact. Texts begin and end outside.

The search takes time that grows with the text: base patterns and checks look at each character a fixed number of times,
however long a word or a run of digits is.

Defined cases: a null text is empty; spans count code points, ends excluded; a secret is a span of the kind
`secret`, listed last; repeated rows all stay; an empty table gives an empty result; other columns are not read by
the search and stay in redaction.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import REMEMBERED, slices, tidied, words_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# Fixed base patterns, in forms that look at each character a fixed number of times: a run of one class is entered at its
# first character only, and is never given back (what follows a run is not of its class, so nothing is lost).
_LOCAL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def emails(text: str) -> list[Span]:
    """Emails at each at sign: the longest part before it that no earlier email holds, and the host after it."""
    out, last = [], 0
    for m in _LOCAL_AT.finditer(text):
        start, at = max(m.start(), last), m.end() - 1
        if start < at and (host := _DOMAIN.match(text, at + 1)):
            last = host.end()
            out.append(("email", start, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start, in time that grows with the length of the text, whatever it holds."""
    out = emails(text) if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_HAS_DIGIT = re.compile("[0-9]")

#: The lines of the labelled table. {kind ...} is a span; <name> is a value that each row draws anew; `|` parts choices.
LINES = """
write to {email <user> at <host> dot <tld>} before noon
contact me: {email <user>(at)<host>(dot)<tld>} thanks
my address is {email <user> [at] <host> [dot] <tld>} as ever
mail {email <user> at <host> dot <tld>} now
send it to {email <user> at <host> dot <tld>} or call
schreib an {email <user> at <host> dot <tld>} bitte
écrire à {email <user> (at) <host> (dot) <tld>} merci
escribe a {email <user> at <host> punto <tld>} ya
reach {email <user>[at]<host>[dot]<tld>} for details
<noise> {email <user>(at)<host>(dot)<tld>} <noise>
<noise> {email <user> at <host> dot <tld>} <noise>
<noise> {email <user> [at] <host> [dot] <tld>} <noise>
<noise> {email <user> AT <host> DOT <tld>} <noise>
<noise> {email <user>(at)<host>.<tld>} <noise>
<noise> {email <user> (at) <host>.<tld>} <noise>
<noise> {email <user>[at]<host>.<tld>} <noise>
the server {ip <byte>[.]<byte>[.]<byte>[.]<byte>} was down
host {ip <byte>(.)<byte>(.)<byte>(.)<byte>} replied
<noise> {ip <byte>[.]<byte>[.]<byte>[.]<byte>} <noise>
<noise> {ip <byte>(.)<byte>(.)<byte>(.)<byte>} <noise>
<noise> {ip <byte>[dot]<byte>[dot]<byte>[dot]<byte>} <noise>
<noise> {ip <byte> dot <byte> dot <byte> dot <byte>} <noise>
<noise> {ip <byte>.<byte>.<byte>[.]<byte>} <noise>
call {phone (<d3>) <d3>-<d4>} after six
phone: {phone (<d3>) <d3>-<d4>} or mail
tel. {phone <d3>-<d3>-<d4>} ask for Jo
ring {phone 030/<d7>} in Berlin
numéro {phone 01 <d2> <d2> <d2> <d2>} à Paris
teléfono {phone 9<d2> <d3> <d3>} en Madrid
call {phone 00 49 30 <d7>} from abroad
dial {phone <d3>.<d3>.<d4>} for help
<noise> {phone (<d3>) <d3>-<d4>} <noise>
<noise> {phone <d3>-<d3>-<d4>} <noise>
<noise> {phone <d3>.<d3>.<d4>} <noise>
<noise> tel. {phone 0<d3> <d3> <d4>} <noise>
<noise> phone: {phone 0<d2>/<d7>} <noise>
<noise> call {phone <d3> <d3> <d4>} <noise>
card {card <card4.>} expires soon
pay with {card <card4_>} please
visa {card <card4/>} ok
<noise> {card <card4.>} <noise>
<noise> {card <card4_>} <noise>
<noise> card {card <card15 >} <noise>
<noise> card: {card <card15->} <noise>
token = {secret "<hex40>"} was leaked
<noise> token = {secret "<hex40>"} <noise>
<noise> token = {secret "<hex32>"} <noise>
<noise> token: {secret <hex40>} <noise>
<noise> secret = {secret '<hex40>'} <noise>
<noise> api_key = {secret "<mixed32>"} <noise>
<noise> api_key: {secret <mixed32>} <noise>
<noise> apikey = {secret "<mixed24>"} <noise>
<noise> password = {secret "<mixed12>"} <noise>
<noise> password: {secret <mixed12>} <noise>
<noise> Authorization: Bearer {secret <mixed40>} <noise>
<noise> {secret AKIA<upper16>} <noise>
<noise> {secret ghp_<mixed36>} <noise>
<noise> {secret sk_live_<mixed24>} <noise>
<noise> {secret password=<mixed12>} <noise>
<noise> {secret token=<hex40>} <noise>
<noise>
<noise>
<noise>
<noise>
<noise>
<noise> at the <plain> <noise>
<noise> dot <noise>
<noise> token <noise>
<noise> password <noise>
<noise> call <plain> <noise>
<noise> call <d2> <noise>
<noise> phone <noise>
<noise> card <noise>
<noise> card <d2> of <d2> <noise>
the cat sat at the door of the house
look at dot patterns and at the end of it
he was at home dot and done
we met at noon in <year> and again in <year>
version <d1>.<d1>.<d1> came out in May <year>
<noise> version <d1>.<d2>.<d1>.<d2>.<d1> <noise>
it cost <d1>,<d3>.00 dollars or 1.<d3> euros
chapter <d2> page <d3> line <d1>
score 3-2 after <d2> minutes
commit <hex40> by <plain>
<noise> commit <hex40> <noise>
<noise> sha256 <hex64> <noise>
<noise> md5 <hex32> <noise>
hash of the file is <hex40> as listed
on <year>-<d2>-<d2> at <d2>:<d2> we left
from <d2>.<d2>.<year> to <d2>.<d2>.<year>
room <d3> of building <d1>
order <d5> has <d1> items of <d2> kg
order <d10> was sent
pi is 3.<d5> and e is 2.<d5>
the years <year> <year> <year> <year> were good
the years <year>-<year> were good
only <d1>%%% of <d3>*** words### are&&& here$$$
numbers 1 2 3 4 5 6 7 8 9 10
numbers <d3> <d3> <d4> <d2> <d3>
tables | <d2> | <d2> | <d2> | <d2>
| <plain> | <plain> | <d3> | <plain> |
ratio <d2>:<d1> or <d1>:<d1> at 1080p
isbn 978-<d1>-<d2>-<d6>-<d1> was listed
call me at the office at nine
<noise> name = "<plain>" <noise>
<noise> count = <d2> <noise>
<noise> id = <d5> <noise>
<noise> <d16bad> <noise>
<noise> <d10> <noise>
<noise> <d3>-<d3> <noise>
<noise> <d2>/<d2>/<year> <noise>
<noise> <d1>.<d1> <noise>
<noise> key <plain> <noise>
<junk>
<junk>
<junk> <noise> <junk>
<caps>
<caps> AT <caps>
<caps> DOT <caps> AT <caps>
<noise> at <noise>
<noise> at <noise>
<noise> | <noise> | <plain> | <noise>
"""
#: Rows that each line becomes, the seed of their values, and in how many rows a feature must be found.
COPIES, SEED, KNOWN = 6, 11, 4

LABELS = ("outside", *KINDS)
N = len(LABELS)
REACH, SEEN = 2, 5  # words that are seen on either side, and what is seen of each
_SYLLABLES = "the and ing er on th re ha ti ou le en es que ment eur sch ung lich keit de la os ción ado que in st hat ern ver be".split()
_HEX = re.compile("[0-9a-f]{16,}|[0-9A-F]{16,}")
_RUNS = [(re.compile("[A-ZÀ-Þ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d{5,}"), "99999")]
_EDGE = "\"'`,;:.!?()[]{}<>|"


def shape(word: str) -> str:
    """Letters as runs of x or X, digits as 9 (five for any longer run), a long run of hexadecimal digits as h, marks as they are."""
    kept = _HEX.sub(lambda m: "\0" if re.search("[0-9]", m.group()) and re.search("[a-fA-F]", m.group()) else m.group(), word)
    kept = re.sub("[0-9]", "9", kept)
    for pattern, by in _RUNS:
        kept = pattern.sub(by, kept)
    return kept.replace("\0", "h")


def outline(word: str) -> str:
    """The shape with any run as one character, but for `at` and `dot` in brackets, and without marks at its edges."""
    kept = re.sub(r"([\[(])(at|dot)([\])])", lambda m: m.group(1) + ("\0" if m.group(2) == "at" else "\1") + m.group(3), word.lower())
    kept = re.sub(r"[^\W\d_]+", "x", re.sub("[0-9]+", "9", kept))
    kept = re.sub("9*x[x9]*(?:[._+-][x9]+)*", "x", kept)
    return re.sub(r"(\W)\1+", r"\1", kept).replace("\0", "at").replace("\1", "dot").strip("\"'`,;:!?|")


def opening(word: str) -> str:
    """What leads a name that is set off by a mark, or the capitals that a word begins with."""
    m = re.match("[\"']*([a-z]+[_=:-]|[A-Z]{4})", word)
    return m.group(1) if m else ""


def sort_of(word: str) -> str:
    """A coarse class: which characters the inside of a word holds, and how long it is."""
    core = word.strip(_EDGE)
    n = len(core)
    if not n:
        return "mark " + word[:1]
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    size = next(str(k) for k in (2, 4, 8, 11, 15, 19, 31, 1 << 62) if n <= k)
    if letters == n:
        return "letters" + (" capital" if core[:1].isupper() else "") + (" long" if n > 24 else "")
    if digits == n:
        return "digits " + size
    if digits and letters and digits + letters >= 0.8 * n and n >= 10:
        return ("hex " if _HEX.fullmatch(core) else "mixed ") + size
    if digits and not letters:
        return f"numbers {size} " + "".join(sorted({c for c in core if not "0" <= c <= "9"}))[:4]
    return "other " + ("9" if digits else "") + ("=" if "=" in core else "")


def named(word: str) -> tuple[str, ...]:
    """What is seen of a word: itself without case and edges, its shape, class, outline and opening."""
    return "w " + word.lower().strip(_EDGE), "s " + shape(word), "c " + sort_of(word), "o " + outline(word), "p " + opening(word)


def _value(name: str, rng: random.Random) -> str:
    """A fresh value of a line's <name>."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    plain = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4)))
    if name == "plain":
        return plain()
    if name == "noise":
        marks = lambda w: w.capitalize() if rng.random() < 0.15 else w + rng.choice(",.;:!?") if rng.random() < 0.15 else w + some("#*$%&", 3) if rng.random() < 0.05 else w
        return " ".join(marks(plain()) for _ in range(rng.randrange(1, 6)))
    if name == "junk":
        return " ".join(plain() + rng.choice("#*$%&|<>!") * 3 for _ in range(rng.randrange(2, 9)))
    if name == "caps":
        return " ".join(plain().upper() + rng.choice(["", "", "!!", ".", ",!!", ".!!"]) for _ in range(rng.randrange(1, 6)))
    if name == "user":
        return rng.choice("anna info sales kim max contact".split()) if rng.random() < 0.2 else plain() + rng.choice(["", "", some(dig, 2), "." + plain(), "_" + plain()])
    if name == "host":
        return rng.choice("host mail web site server office phone card".split()) if rng.random() < 0.3 else plain() + rng.choice(["", "", some(dig, 1), "-" + plain()])
    if name == "tld":
        return rng.choice("com org net de fr es edu io".split())
    if name == "byte":
        return str(rng.randrange(256))
    if name == "year":
        return str(rng.randrange(1900, 2030))
    kind, n = re.fullmatch(r"([a-z]+?)(\d.*)", name).groups()
    if kind == "d" and n == "16bad":
        d = some(dig, 16)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)
    if kind == "d":
        return some(dig, int(n))
    if kind == "card":
        d = some("3456", 1) + some(dig, 13 if n[:2] == "15" else 14)
        d += next(c for c in dig if luhn(d + c))
        parts = [d[:4], d[4:10], d[10:]] if n[:2] == "15" else [d[:4], d[4:8], d[8:12], d[12:]]
        return n[2 if n[:2] == "15" else 1 :].join(parts)
    letters = {"hex": dig + "abcdef", "mixed": low + up + dig + dig, "upper": up + dig}[kind]
    while True:
        found = some(letters, int(n))
        if re.search("[0-9]", found) and re.search("[A-Za-z]", found):
            return found


def labelled_table(copies: int = COPIES, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    """Words and labels: each of LINES so many times, with values of its own."""
    rng, out = random.Random(seed), []
    for line in LINES.strip().splitlines() * copies:
        words, labels = [], []
        for m in re.finditer(r"\{(\w+) ([^}]*)\}|[^{]+", line):
            body = re.sub("<([a-z0-9._/ -]+)>", lambda v: _value(v.group(1), rng), m.group(2) or m.group()).split()
            words += body
            labels += [LABELS.index(m.group(1)) if m.group(1) else 0] * len(body)
        out.append((words, labels))
    return out


class Model:
    """Weights of what is seen of a word at each distance from -REACH to REACH, and of label pairs.

    `names` has a number for each word, shape and class that the labelled table holds; what it doesn't hold has no weight.
    """

    def __init__(self) -> None:
        self.names: dict[str, int] = {"": 0, "edge": 1}
        self.weight = np.zeros((2 * REACH + 1, 2, N))
        self.pair = np.zeros((N, N))
        self.bias = np.zeros(N)

    def seen(self, word: str) -> tuple[int, ...]:
        """Numbers of what `named` tells of a word; 0 for what is unknown."""
        return tuple(self.names.get(name, 0) for name in named(word))

    def emissions(self, words: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Evidence for each label at each position. words: what is seen of distinct words; code: the word at each position; first: where texts begin."""
        seen = np.vstack([words.reshape(-1, SEEN), [[1] + [0] * (SEEN - 1)]])  # the last stands beyond the ends of a text
        doc = np.searchsorted(first, np.arange(len(code)), "right")
        out = np.tile(self.bias.astype(np.float32), (len(code), 1))
        for k in range(2 * REACH + 1):
            each = self.weight[k][seen].sum(1).astype(np.float32)
            step = k - REACH
            at = np.full(len(code), len(seen) - 1)
            if step <= 0:
                at[-step:] = np.where(doc[-step:] == doc[: len(doc) + step], code[: len(code) + step], len(seen) - 1)
            else:
                at[:-step] = np.where(doc[:-step] == doc[step:], code[step:], len(seen) - 1)
            out += each[at]
        return out

    def train(self, table: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 1.0, ridge: float = 0.3) -> Model:
        """Gradient ascent (AdaGrad) on the conditional likelihood, by forward and backward sums over all rows at once.

        What fewer than KNOWN rows hold is no feature: it would be learned by heart.
        """
        rows: dict[str, int] = {}
        for words, _ in table:
            for name in {name for w in words for name in named(w)}:
                rows[name] = rows.get(name, 0) + 1
        self.names = {"": 0, "edge": 1}
        for name, n in rows.items():
            if n >= KNOWN:
                self.names[name] = len(self.names)
        b, t = len(table), max(len(words) for words, _ in table)
        size = np.array([len(words) for words, _ in table])
        seen = np.zeros((b, t + 2 * REACH, SEEN), np.int64)
        seen[:, :, 0] = 1
        y = np.zeros((b, t), np.int64)
        for i, (words, labels) in enumerate(table):
            seen[i, REACH : REACH + len(words)] = [self.seen(w) for w in words]
            y[i, : len(words)] = labels
        live = np.arange(t) < size[:, None]
        self.weight = np.zeros((2 * REACH + 1, len(self.names), N))
        weights = [self.weight, self.pair, self.bias]
        squares = [np.full(w.shape, 1e-6) for w in weights]
        row = np.arange(b)
        true_pairs = np.zeros((N, N))
        np.add.at(true_pairs, (np.where(np.arange(t) > 0, np.roll(y, 1, 1), 0)[live], y[live]), 1)
        np.add.at(true_pairs, (y[row, size - 1], 0), 1)
        cells = [seen[:, k : k + t][live].reshape(-1) for k in range(2 * REACH + 1)]
        for _ in range(rounds):
            e = self.bias + sum(self.weight[k][seen[:, k : k + t]].sum(2) for k in range(2 * REACH + 1))
            alpha, beta = np.zeros((b, t, N)), np.zeros((b, t, N))
            alpha[:, 0] = e[:, 0] + self.pair[0]
            for i in range(1, t):
                alpha[:, i] = e[:, i] + _sum(alpha[:, i - 1, :, None] + self.pair, 1)
            beta[row, size - 1] = self.pair[:, 0]
            for i in range(t - 2, -1, -1):
                inside = live[:, i + 1]
                beta[inside, i] = _sum(self.pair + (e[inside, i + 1] + beta[inside, i + 1])[:, None, :], 2)
            z = _sum(alpha[row, size - 1] + beta[row, size - 1], 1)
            d = -np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[:, :, None]
            of_pairs = true_pairs.copy()
            of_pairs[0] += d[:, 0].sum(0)
            of_pairs[:, 0] += d[row, size - 1].sum(0)
            for i in range(1, t):
                inside = live[:, i]
                of_pairs -= np.exp(alpha[inside, i - 1, :, None] + self.pair + (e[inside, i] + beta[inside, i] - z[inside, None])[:, None, :]).sum(0)
            np.add.at(d, (row[:, None], np.arange(t), y), live)
            flat = d[live]
            of_words = np.stack([np.stack([np.bincount(at, np.repeat(flat[:, n], SEEN), len(self.names)) for n in range(N)], 1) for at in cells])
            of_words[:, 0] = 0
            for w, g, s in zip(weights, (of_words, of_pairs, d.sum((0, 1))), squares, strict=True):
                g -= ridge * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def best(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of the best path of each text; e: emissions of all words, first: where texts begin."""
        out = np.zeros(len(e), np.int8)
        if not len(e):
            return out
        pair, out_ = self.pair, self.pair[0, 0]
        stay = pair[1:, 1:].max() - out_
        edges = pair[0, 1:].max() + pair[1:, 0].max() - 2 * out_ - stay
        # Running sums of the evidence against outside; texts are set apart, so that no run spans two.
        apart = 1e6 * (np.searchsorted(first, np.arange(len(e)), "right"))
        total = np.concatenate([[0.0], np.cumsum(e[:, 1:].max(1) - e[:, 0] + stay, dtype=float)])
        low = np.minimum.accumulate(total[:-1] - apart)
        high = np.maximum.accumulate((total[1:] - apart)[::-1])[::-1]
        loose = high - low + edges >= -1e-6
        at = np.flatnonzero(loose)
        if not len(at):
            return out
        starts = np.zeros(len(e) + 1, bool)
        starts[first] = True
        new = np.append(True, (np.diff(at) > 1) | starts[at[1:]])
        begin = at[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        order = np.argsort(size, kind="stable")
        # Batches of about as many cells, so that one long piece doesn't widen thousands of short ones.
        a = 0
        while a < len(order):
            n = 1 + int(np.searchsorted(size[order[a:]] * np.arange(1, len(order) - a + 1), 1 << 18))
            part = order[a : a + n]
            self._viterbi(e, begin[part], size[part], out)
            a += n
        return out

    def _viterbi(self, e: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Pieces padded to one length; beyond each end it is outside."""
        t = int(size.max())
        at = begin[:, None] + np.minimum(np.arange(t), size[:, None] - 1)
        back = np.zeros((t, len(begin), e.shape[1]), np.int8)
        score = e[at[:, 0]] + self.pair[0]
        finals = score.copy()
        for i in range(1, t):
            steps = score[:, :, None] + self.pair
            back[i] = steps.argmax(1)
            score = steps.max(1) + e[at[:, i]]
            live = size > i
            finals[live] = score[live]
        finals = finals + self.pair[:, 0]
        label = finals.argmax(1)
        rows = np.arange(len(begin))
        for i in range(t - 1, -1, -1):
            live = size > i
            out[begin[live] + i] = label[live]
            label = np.where(live & (i > 0), back[i, rows, label], label)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of exponentials."""
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@lru_cache(1)
def trained() -> Model:
    return Model().train(labelled_table())


_AT = re.compile(r"\Wat\W")
_LAST = re.compile(r"(?:\.|\W(?:dot|punto)\W)\s*")
_MARK = re.compile(r"\W*(?:at|dot|punto)\W*|\W(?:at|dot|punto)\W.*|.*\W(?:at|dot|punto)\W", re.S)


def spelled_out(text: str) -> bool:
    """A name, `at` between marks, a host, and a dot or `dot` before the last word; no two plain words in a row."""
    text = text.lower()
    at = _AT.search(text, 1)
    if not at or text[0].isspace():
        return False
    tail = len(text) - len(re.match(r"\w*", text[::-1]).group())
    begin = max(at.end(), len(text[:tail].rstrip()) - 6)
    if tail == len(text) or not any(_LAST.fullmatch(text, k, tail) for k in range(begin, tail)):
        return False
    # of a word only its ends can be a mark between words
    plain = [not _MARK.fullmatch(w if len(w) <= 16 else w[:8] + w[-8:]) for w in text.split()]
    return not any(a and b for a, b in itertools.pairwise(plain))


def sound(kind: str, text: str) -> bool:
    """The arithmetic of a kind; which words are meant the field decides."""
    digits = _digits(text)
    if kind == "email":
        return spelled_out(text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p[:9]) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return len(text) >= 8 and bool(digits) and any(c.isalpha() for c in text)


def trim(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """Without marks that open before or close after, and of a secret without the name that it is given to."""
    if kind == "secret":
        a = max(a, text.rfind("=", a, b) + 1 if not text[a:b].rstrip("\"'.,;").endswith("=") else a)
    while b > a and text[b - 1] in ".,;:!?#$%&*\"'|`":
        b -= 1
    while a < b and text[a] in "#$%&*\"'|,;:`":
        a += 1
    return a, b


class Finder:
    """Spans of texts; remembers what is seen of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.plain = model.seen("zyx"), model.seen("Zyx")  # words of letters that the table doesn't hold

    def labels(self, words) -> np.ndarray:
        coded = words.strings().dictionary_encode()
        seen, known, names, (plain, capital) = [], self.known, self.model.names, self.plain
        for w in coded.dictionary.to_pylist():
            s = known.get(w)
            if s is None:
                if w.isalpha() and len(w) <= 24 and w.isascii() and "w " + w.lower() not in names and (w.islower() or w[1:].islower()):
                    s = plain if w.islower() else capital
                else:
                    s = self.model.seen(w)
                    if len(known) < REMEMBERED:
                        known[w] = s
            seen.append(s)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.model.best(self.model.emissions(np.array(seen, np.int64), code, words.first[:-1]), words.first)

    def spans(self, column: pa.Array) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text."""
        words = words_of(column)
        label = self.labels(words)
        texts = column.fill_null("").to_pylist()
        found = [base_spans(t) for t in texts]
        more: dict[int, list[Span]] = {}
        at = np.flatnonzero(label)
        if len(at):
            new = np.append(True, (np.diff(at) > 1) | (np.diff(label[at]) != 0) | (np.diff(words.doc[at]) != 0))
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points before each byte
            taken: dict[int, tuple[list[int], list[int]]] = {}
            for k in np.split(at, np.flatnonzero(new)[1:]):
                d = int(words.doc[k[0]])
                a, b = (int(points[i] - points[words.at[d]]) for i in (words.start[k[0]], words.end[k[-1]]))
                kind = LABELS[label[k[0]]]
                a, b = trim(kind, texts[d], a, b)
                if d not in taken:
                    held = sorted((s, e) for _, s, e in found[d])
                    taken[d] = [s for s, _ in held], list(itertools.accumulate((e for _, e in held), max))
                starts, ends = taken[d]
                before = bisect.bisect_left(starts, b)  # base spans that start before it ends
                if b > a and sound(kind, texts[d][a:b]) and not (before and ends[before - 1] > a):
                    more.setdefault(d, []).append((kind, a, b))
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        return [(f, sorted(f + more.get(d, []), key=order)) for d, f in enumerate(found)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every whole text."""
    model = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = finder.spans(batch.column(1).slice(a, b - a))
                lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[i]] for f in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(tidied(run), f"doc_id long, base {spans}, spans {spans}")


def redact(text: str, spans: list[Span]) -> str:
    """text with each span, or chain of overlapping spans, as its kind in brackets."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, done = [], 0
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with spans replaced in text, all other columns as they are; a null text stays null."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            for a, b in slices(batch.column(i)):
                part = batch.slice(a, b - a)
                column = part.column(i)
                found = finder.spans(column)
                text = pa.array([None if t is None else redact(t, f[1]) if f[1] else t for t, f in zip(column.to_pylist(), found, strict=True)], column.type)
                yield part.set_column(i, part.schema.field(i), text)

    return docs.mapInArrow(tidied(run), docs.schema)
