"""Personal data: exact base patterns, and more spans from a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are always reported.  Outside them, zones around
digits, @, (at) and groups of hexadecimal letters are cut into tokens, and every segment
of up to ``MAX_TOKENS`` tokens is scored under every kind by features of the segment
as a whole: whether its form is one of the kind's, its checksum, how many digits and
tokens it has, what separates them, what it begins and ends with and touches, and cue
words before it.  Label transitions are scored too.  The weights maximise the
conditional likelihood of generated sentences (forward-backward over segments,
stochastic gradient); Viterbi over segments picks boundaries and types jointly.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

# Base kinds in order, then the kinds that only the field reports.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "mac", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
MAX_TOKENS = 40
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# What can only go on an address whose segment the bound has cut.
_MORE_DOMAIN = re.compile(r"(?:(?:\.| ?[\[({](?i:dot)[\])}] ?)\w(?:[\w-]*\w)?)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A segment holds no other characters than these; others, line ends too, part zones.
_BARRIER = re.compile(r"[^\w .\-:()\[\]{}@+%/]")
_STOP = re.compile(r"[^\w.\-:()\[\]{}@+%/]")
_TOKEN = re.compile(r"[^\W_]+| +|.", re.S)
_TRIGGER_PATTERN = r"[0-9@]|[\[({](?:[Aa]|[Dd][Oo])[Tt][\])}]|[A-Fa-f]{1,4}::?[A-Fa-f]{1,4}:|[A-Fa-f]{2}-[A-Fa-f]{2}-"
_TRIGGER = re.compile(_TRIGGER_PATTERN)
_SIDE = 2
_FORMS = str.maketrans(
    {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "Z"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "z")}
)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches by anchoring at each @, so that long runs without one cost nothing extra."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind; failing matches are dropped."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    at = 0
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


# Forms of a kind's segments: 0 is a digit (oo two leading zeros), A and a a hexadecimal letter, Z and z another one, w a longer word, @ and dots may be α and δ in brackets.
_AT, _DOT = r"(?:@| ?[\[({]α[\])}] ?)", r"(?:\.| ?[\[({]δ[\])}] ?)"
_HEX = r"[0oAa]{1,4}"
_SHAPES = {
    "email": rf"\w(?:[\w.%+-]*\w)?{_AT}\w(?:[\w-]*\w)?(?:{_DOT}\w(?:[\w-]*\w)?)+",
    "ip": rf"(?:{_HEX}:){{7}}{_HEX}|(?=(?:{_HEX}:|:){{3,7}}{_HEX})(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})|[0o]{{1,3}}(?:[\[({{]\.[\])}}][0o]{{1,3}}){{3}}",
    "card": r"[0o]{14,19}|[0o]{4}(?:[ .-][0o]{4}){3}|[0o]{4}[ .-][0o]{6}[ .-][0o]{5}",
    "phone": r"\([0o]{2,5}\)[ -]?[0o]{3,4}(?:[ .-]?[0o]{3,4})?|[0o]{3}[.-][0o]{3}[.-][0o]{4}|oo0{1,3}(?:[ ./-][0o]{2,8}){1,4}",
    "iban": r"[AZ]{2}[0o]{2}(?: ?[0oAZ]{4}){2,7}(?: ?[0oAZ]{1,3})?",
    "mac": r"[0oAa]{2}(?:[:-][0oAa]{2}){5}|[0oAa]{4}\.[0oAa]{4}\.[0oAa]{4}",
    "ssn": r"[0o]{3}-[0o]{2}-[0o]{4}",
}
_SHAPES = {k: re.compile(p) for k, p in _SHAPES.items()}
_CUES = {
    "email": ("email", "mail", "contact"), "ip": ("ip", "host", "address"), "card": ("card", "visa", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"), "iban": ("iban", "account", "konto"),
    "mac": ("mac", "device"), "ssn": ("ssn", "social", "security"),
}
_NOT_CUES = ("order", "version", "isbn", "invoice", "part", "serial", "id", "no", "page")
_K = len(KINDS)
_OUT = _K
#: One bit for each kind that a word is a cue of, and one more for words that speak against any.
_CUE_BITS = {w: sum(1 << k for k, kind in enumerate(KINDS) if w in _CUES[kind]) for words in _CUES.values() for w in words} | dict.fromkeys(_NOT_CUES, 1 << _K)
_LEFT, _RIGHT = frozenset("-.:/#_@+$"), frozenset("-:/_@")


def _checksum(kind: str, s: str) -> bool | None:
    """Whether the kind's own checksum or ranges hold; None if it has none."""
    if kind == "card":
        return luhn(_digits(s))
    if kind == "iban":
        c = s.replace(" ", "")
        return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    if kind == "ssn":
        a, b, c = s.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if kind == "ip" and ":" not in s:
        return all(int(x) <= 255 for x in re.findall("[0-9]+", s))
    return None


def _chunk_end(text: str, at: int, last: int) -> int:
    m = _STOP.search(text, at, last)
    return m.start() if m else last


def _zone_start(text: str, at: int, first: int) -> int:
    """Start of the chunk around ``at`` and of ``_SIDE`` more before it, none beyond a barrier."""
    for _ in range(_SIDE + 1):
        cut = text.rfind(" ", first, at)
        low = cut + 1 if cut >= 0 else first
        stop = _BARRIER.search(text[low:at][::-1])
        if stop:
            return at - stop.start()
        if cut < 0:
            return first
        at = cut
    return low


def zones(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of tokens around triggers that lie outside the spans taken: whole chunks between spaces, with ``_SIDE`` more on either side, up to barriers; a run is one zone, however long."""
    gaps, at, found = [], 0, []
    for s, e in sorted(taken):
        if s > at:
            gaps.append((at, s))
        at = max(at, e)
    gaps.append((at, len(text)))
    for pos, last in gaps:
        while m := _TRIGGER.search(text, pos, last):
            low, high, ahead = _zone_start(text, m.start(), pos), _chunk_end(text, m.end() - 1, last), True
            while ahead:
                end, ahead = high, False
                for _ in range(_SIDE):
                    if end >= last or text[end] != " ":
                        break
                    begin, end = end, _chunk_end(text, end + 1, last)
                    if _TRIGGER.search(text, begin, end):
                        high, ahead = end, True
                        break
                else:
                    high = high if ahead else end
                if not ahead:
                    high = end
            found.append([(t.start(), t.end()) for t in _TOKEN.finditer(text, low, high)])
            pos = max(high, m.end())
    return found


@lru_cache(maxsize=20_000)
def _form(token: str) -> str:
    """A token's form: its characters' classes; words without digits keep their length only where a kind may ask for it."""
    if not token[0].isalnum():
        return " " if token[0] == " " else token
    if token.isalpha():
        low = token.lower()
        if low in ("at", "dot"):
            return "α" if low == "at" else "δ"
        if len(token) > 4 or not token.isascii():
            return "w"
        form = token.translate(_FORMS)
        return form if "Z" in form and form.isupper() or "z" not in form and "Z" not in form else "w"
    if len(token) > 34 or not token.isascii():
        return "w0"
    return "oo" + "0" * (len(token) - 2) if token.startswith("00") and token.isdigit() else token.translate(_FORMS)


@lru_cache(maxsize=5_000)
def _shaped(forms: tuple[str, ...]) -> tuple[tuple[int, int, int], ...]:
    """(first token, number of tokens, kind) of every segment of the bound whose form is one of the kind's."""
    edges = np.cumsum([0, *map(len, forms)]).tolist()
    whole, n, found = "".join(forms), len(forms), []
    for k, kind in enumerate(KINDS):
        shape = _SHAPES[kind]
        for i in range(n):
            # Where not even a beginning has the form, no longer or shorter segment has.
            if forms[i] == " " or not shape.match(whole, edges[i], edges[min(n, i + MAX_TOKENS)]):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                if forms[j - 1] != " " and shape.fullmatch(whole, edges[i], edges[j]):
                    found.append((i, j - i, k))
    return tuple(sorted(found))


# Values of each feature: of segments alone, by kind; weights are tables of (value, kind).
_GROUPS = {"shape": 4, "digits": 11, "tokens": 11, "separators": 4, "edges": 4, "touches": 4, "notcue": 2, "cue": 2}


@dataclass
class Weights:
    of: dict[str, np.ndarray]
    move: np.ndarray

    @staticmethod
    def zero() -> Weights:
        return Weights({g: np.zeros((n, _K)) for g, n in _GROUPS.items()}, np.zeros((_K + 1, _K + 1)))


@dataclass
class Zone:
    """What the features of a zone's segments need: forms, cue bits before each token, checks of shaped segments, and whether the zone's sides are touched."""

    forms: tuple[str, ...]
    cues: tuple[int, ...]
    checks: tuple[int, ...]
    sides: tuple[bool, bool]

    def key(self) -> tuple:
        return self.forms, self.cues, self.checks, self.sides


def read_zone(text: str, tokens: list[tuple[int, int]]) -> Zone:
    low, high = tokens[0][0], tokens[-1][1]
    before = re.findall(r"[^\W\d_]+", text[max(0, low - 40) : low].lower())[-3:]
    last, cues, forms = [_CUE_BITS.get(w, 0) for w in before], [], []
    for s, e in tokens:
        token = text[s:e]
        cues.append(0)
        for bits in last[-3:]:
            cues[-1] |= bits
        forms.append(_form(token))
        if token.isalpha():
            last.append(_CUE_BITS.get(token.lower(), 0))
    forms = tuple(forms)
    checks = []
    for i, n, k in _shaped(forms):
        good = _checksum(KINDS[k], text[tokens[i][0] : tokens[i + n - 1][1]])
        checks.append(1 if good is None else 2 if good else 3)
    left, right = text[low - 1 : low], text[high : high + 1]
    return Zone(forms, tuple(cues), tuple(checks), (left.isalnum() or left in _LEFT, right.isalnum() or right in _RIGHT))


def features(zone: Zone, first: int, last: int, bound: int) -> dict[str, np.ndarray]:
    """Values of every feature of the segments that start at tokens first .. last - 1, by (start, length - 1), and for shape and cue by kind too; segments beyond the zone's end have any."""
    # Only the tokens that these segments hold are looked at, and one on either side.
    forms = zone.forms[first : last + bound]
    n, more = len(forms), first + len(forms) < len(zone.forms)
    start, length = np.arange(last - first)[:, None], np.arange(1, bound + 1)[None, :]
    end = np.minimum(start + length, n)
    word = np.array([f[0].isalnum() for f in forms])
    digits = np.concatenate([[0], np.cumsum([sum(c in "0o" for c in f) for f in forms])])
    touches = lambda f, of: f[-1].isalnum() or f in of
    left = np.array([touches(zone.forms[first - 1], _LEFT) if first else zone.sides[0], *(touches(f, _LEFT) for f in forms)])
    right = np.array([*(touches(f, _RIGHT) for f in forms), touches(zone.forms[first + n], _RIGHT) if more else zone.sides[1]])
    kinds_of = np.zeros(start.shape[:1] + length.shape[1:], np.int64)
    for sign in sorted(set(forms) - {f for f, w in zip(forms, word) if w}):
        seen = np.concatenate([[0], np.cumsum([f == sign for f in forms])])
        kinds_of += seen[end] > seen[start]
    shape = np.zeros((last - first, bound, _K), np.int64)
    shaped = _shaped(zone.forms)
    low, high = bisect.bisect_left(shaped, (first,)), bisect.bisect_left(shaped, (last,))
    for (i, size, k), check in zip(shaped[low:high], zone.checks[low:high]):
        if size <= bound:
            shape[i - first, size - 1, k] = check
    cues = np.array(zone.cues)[first:last]
    return {
        "shape": shape,
        "digits": np.minimum(digits[end] - digits[start], 20) // 2,
        "tokens": np.broadcast_to(np.minimum(length, 40) // 4, kinds_of.shape),
        "separators": np.minimum(kinds_of, 3),
        "edges": word[start] * 2 + word[end - 1],
        "touches": left[start] * 2 + right[end],
        "notcue": np.broadcast_to((cues >> _K & 1)[:, None], kinds_of.shape),
        "cue": np.broadcast_to((cues[:, None] >> np.arange(_K) & 1)[:, None, :], shape.shape),
    }


_EVERY = np.arange(_K)


def potentials(found: dict[str, np.ndarray], weights: Weights) -> np.ndarray:
    """Score of each segment under each kind: the sum of its features' weights."""
    return sum(weights.of[g][v, _EVERY] if v.ndim == found["shape"].ndim else weights.of[g][v] for g, v in found.items())


def decode_zone(zone: Zone, weights: Weights, bound: int = MAX_TOKENS) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the best segmentation: Viterbi over all segments of up to ``bound`` tokens; outside tokens score nothing but their transitions."""
    n = len(zone.forms)
    bound = min(bound, n)
    ends, into = np.full((n + 1, _K + 1), -np.inf), np.full((n + 1, _K + 1), -np.inf)  # best scores by the label that ended, or starts, at a token
    ends[0, _OUT] = 0.0
    into[0] = weights.move[_OUT]
    size, lengths, carried, base = np.zeros((n + 1, _K), np.int64), np.arange(1, bound + 1), np.zeros((0, bound, _K)), 0
    for low in range(0, n, 1024):
        high = min(low + 1024, n)
        score = np.concatenate([carried, potentials(features(zone, low, high, bound), weights)])
        starts = np.arange(low + 1, high + 1)[:, None] - lengths
        by_end = score[np.maximum(starts - base, 0), lengths - 1]
        by_end[starts < 0] = -np.inf
        for j in range(low + 1, high + 1):
            m = min(bound, j)
            ways = into[j - m : j, :_K][::-1] + by_end[j - low - 1, :m]
            size[j] = way = ways.argmax(axis=0)
            now = ends[j]
            now[:_K] = ways[way, _EVERY]
            now[_OUT] = into[j - 1, _OUT]
            (now[:, None] + weights.move).max(axis=0, out=into[j])
        carried, base = score[max(0, len(score) - bound) :], high - min(bound, len(score))
    found, j, label = [], n, int(ends[n].argmax())
    while j:
        i = j - 1 if label == _OUT else j - 1 - int(size[j, label])
        if label != _OUT:
            found.append((i, j, label))
        j, label = i, int((ends[i] + weights.move[:, label]).argmax())
    return found[::-1]


def training_sentences(n: int = 1500, seed: int = 7):
    """Generated sentences with gold spans, and look-alikes that are no personal data."""
    rnd = random.Random(seed)
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["an", "the", "er", "on", "re", "la", "qu", "ei"]) for _ in range(rnd.randint(1, 3)))
    hexes = lambda k: "".join(rnd.choice(rnd.choice(["0123456789", "abcdef"])) for _ in range(k))

    def card(separators=(".", "-", " ")):
        d = "4" + number(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rnd.choice(separators).join(d[k : k + 4] for k in range(0, 16, 4))

    def iban():
        body = number(18)
        rest = int("".join(str(int(x, 36)) for x in body + "DE00")) % 97
        whole = f"DE{98 - rest:02d}{body}"
        return whole if rnd.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, 22, 4))

    def email():
        at, dot = rnd.choice([(" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" (AT) ", " (DOT) "), ("{at}", ".")])
        local = rnd.choice([".", "-", "_"]).join(word() for _ in range(rnd.randint(1, 6)))
        return f"{local}{at}{word()}{''.join(dot + word() for _ in range(rnd.randint(0, 1)))}{dot}{rnd.choice(['com', 'de', 'org'])}"

    def address():
        groups = [hexes(rnd.randint(1, 4)) for _ in range(8)]
        cut = rnd.randint(1, 3)
        return rnd.choice([":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[cut : rnd.randint(cut + 2, 7)]), "[.]".join(str(rnd.randint(1, 255)) for _ in range(4))])

    make = {
        "email": email, "ip": address, "card": card, "iban": iban,
        "phone": lambda: rnd.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"00{rnd.randint(1, 99)} {number(3)} {number(4)}", f"0049 {number(2)} {number(7)}", f"{number(3)}.{number(3)}.{number(4)}"]),
        "mac": lambda: rnd.choice([":", "-"]).join(hexes(2) for _ in range(6)),
        "ssn": lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
    }
    plain = [
        lambda: f"version {number(1)}.{number(2)}.{number(1)}", lambda: f"order {number(3)}-{number(3)}-{number(4)}", lambda: f"{number(4)}-{number(2)}-{number(2)}",
        lambda: f"part {number(3)}-{number(2)}-{number(4)}", lambda: number(rnd.randint(1, 12)), lambda: f"{number(2)}:{number(2)}:{number(2)}",
        lambda: f"serial {number(4)}-{number(4)}-{number(4)}-{number(4)}", lambda: f"000-{number(2)}-{number(4)}", lambda: hexes(32), lambda: f"${number(3)}.{number(2)}",
        lambda: f"{number(3)} {number(3)} {number(4)} {word()}", lambda: f"page {number(3)}", lambda: f"x{number(3)}-{number(2)}-{number(4)}", lambda: f"id {number(3)}.{number(3)}.{number(4)}",
        lambda: f"{number(2)}-{number(2)}-{number(4)}", lambda: f"{number(4)} {word()} {number(2)}", lambda: f"{number(1)}:{number(2)} {number(1)}:{number(2)}", lambda: f"({number(4)})", lambda: f"{number(3)}-{number(3)}",
        lambda: f"{number(3)}-{number(4)} {number(16)}", lambda: f"{word()}@{word()}", lambda: f"{number(3)}-{number(2)}-{number(4)}-{number(2)}", lambda: "face::bad", lambda: f"{number(4)}-{number(4)}-{number(4)}-{number(4)}-{number(4)}",
    ]
    for _ in range(n):
        text, gold = "", []
        for _ in range(rnd.randint(2, 4)):
            text += " ".join(word() for _ in range(rnd.randint(2, 5))) + " "
            if rnd.random() < 0.1:
                # A card that base patterns miss, since it follows other digits.
                for kind, value in (("phone", f"({number(3)}) {number(3)}-{number(4)}"), ("card", card([""]))):
                    gold.append((len(text), len(text) + len(value), kind))
                    text += value + " "
            elif rnd.random() < 0.6:
                kind = rnd.choice(list(make))
                if rnd.random() < 0.6:
                    text += rnd.choice(_CUES[kind]) + rnd.choice([" ", ": "])
                value = make[kind]()
                gold.append((len(text), len(text) + len(value), kind))
                text += value + rnd.choice([" ", ", ", ". "])
            else:
                text += rnd.choice(plain)() + rnd.choice([" ", ", ", ". "])
        yield text, gold


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top[~np.isfinite(top)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def log_likelihood(batch: list[tuple[Zone, list[tuple[int, int, int]]]], weights: Weights, bound: int = MAX_TOKENS) -> tuple[float, Weights]:
    """Conditional log-likelihood of the zones' gold segmentations and its gradient, by forward-backward over segments."""
    sizes = np.array([len(z.forms) for z, _ in batch])
    n, t = len(batch), int(sizes.max())
    bound = min(bound, t)
    found = {g: np.zeros((n, t, bound) + ((_K,) if g in ("shape", "cue") else ()), np.int64) for g in _GROUPS}
    for b, (zone, _) in enumerate(batch):
        m = min(bound, sizes[b])
        for g, v in features(zone, 0, int(sizes[b]), int(m)).items():
            found[g][b, : sizes[b], :m] = v
    score = potentials(found, weights)
    beyond = np.arange(t)[None, :, None] + np.arange(1, bound + 1)[None, None, :] > sizes[:, None, None]
    score[beyond] = -np.inf
    into = np.full((n, t + 1, _K + 1), -np.inf)  # by label that starts at a token
    ends = np.full((n, t + 1, _K + 1), -np.inf)  # by label that ended there
    ends[:, 0, _OUT] = 0.0
    for j in range(t + 1):
        if j:
            m = min(bound, j)
            at = j - np.arange(1, m + 1)
            ends[:, j, :_K] = _lse(into[:, at, :_K] + score[:, at, np.arange(m)], 1)
            ends[:, j, _OUT] = into[:, j - 1, _OUT]
        into[:, j] = _lse(ends[:, j, :, None] + weights.move, 1)
    rows = np.arange(n)
    whole = _lse(ends[rows, sizes], 1)
    after = np.full((n, t + 1, _K + 1), -np.inf)  # from a label that ended at a token to the end
    enter = np.full((n, t + 1, _K + 1), -np.inf)  # from a label that starts at a token to the end
    for j in range(t, -1, -1):
        if j < t:
            m = min(bound, t - j)
            enter[:, j, :_K] = _lse(score[:, j, :m] + after[:, j + 1 : j + 1 + m, :_K], 1)
            enter[:, j, _OUT] = after[:, j + 1, _OUT]
            after[:, j] = _lse(weights.move + enter[:, j, None, :], 2)
        after[sizes == j, j] = 0.0
    grad = Weights.zero()
    end = np.minimum(np.arange(t)[:, None] + np.arange(1, bound + 1)[None, :], t)
    mass = np.exp(into[:, :t, None, :_K] + score + after[:, end, :_K] - whole[:, None, None, None])
    moves = np.exp(ends[:, :t, :, None] + weights.move + enter[:, :t, None, :] - whole[:, None, None, None])
    moves[np.arange(t)[None, :] >= sizes[:, None]] = 0.0
    grad.move -= moves.sum(axis=(0, 1))
    value = -whole.sum()
    for b, (zone, gold) in enumerate(batch):
        label, at = _OUT, 0
        for i, j, k in [*gold, (int(sizes[b]), 0, -1)]:
            for _ in range(at, i):
                grad.move[label, _OUT] += 1
                value += weights.move[label, _OUT]
                label = _OUT
            if k >= 0:
                mass[b, i, j - i - 1, k] -= 1
                grad.move[label, k] += 1
                value += weights.move[label, k] + score[b, i, j - i - 1, k]
                label, at = k, j
    for g, v in found.items():
        for k in range(_K):
            grad.of[g][:, k] -= np.bincount((v[..., k] if v.ndim == 4 else v).ravel(), weights=mass[..., k].ravel(), minlength=_GROUPS[g])
    return float(value), grad


def gold_zones(sentences) -> list[tuple[Zone, list[tuple[int, int, int]]]]:
    """Zones of sentences with their gold segments; spans that base patterns find are not the field's."""
    out = []
    for text, gold in sentences:
        for tokens in zones(text, [(s, e) for s, e, _ in base_spans(text)]):
            first, last = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            own = [(first[s], last[e], KINDS.index(k)) for s, e, k in gold if s in first and e in last]
            if all(j - i <= MAX_TOKENS for i, j, _ in own):
                out.append((read_zone(text, tokens), own))
    return out


@lru_cache(maxsize=4)
def trained_weights(n: int = 1000, rounds: int = 8, seed: int = 7) -> Weights:
    """Weights of greatest likelihood on ``training_sentences``, by adaptive stochastic gradient with a small quadratic penalty."""
    data = sorted(gold_zones(training_sentences(n, seed)), key=lambda x: len(x[0].forms))
    batches = [data[k : k + 64] for k in range(0, len(data), 64)]
    weights, seen, rnd = Weights.zero(), Weights.zero(), random.Random(seed)
    for _ in range(rounds):
        rnd.shuffle(batches)
        for batch in batches:
            _, grad = log_likelihood(batch, weights)
            for w, g, v in [(weights.move, grad.move, seen.move), *[(weights.of[x], grad.of[x], seen.of[x]) for x in _GROUPS]]:
                g -= 0.01 * w
                v += g * g
                w += 0.7 * g / np.sqrt(v + 1e-6)
    return weights


def _grown(text: str, start: int, end: int) -> tuple[int, int]:
    """An address with all of the local part before it and of the domain after it."""
    low = start
    while low and text[low - 1] in _LOCAL_CHARS:
        low -= 1
    while low < start and not text[low].isalnum():
        low += 1
    more = _MORE_DOMAIN.match(text, end)
    return low, more.end() if more else end


def find_spans(text: str, weights: Weights, known: dict | None = None) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of all spans, ordered by start, kind and end; ``known`` keeps the segmentations of zones that look alike."""
    base = base_spans(text)
    known, more = {} if known is None else known, []
    for tokens in zones(text, [(s, e) for s, e, _ in base]):
        zone = read_zone(text, tokens)
        key = zone.key()
        if key not in known:
            if len(known) >= 20_000:
                known.clear()
            known[key] = decode_zone(zone, weights)
        end = -1
        for i, j, k in known[key]:
            span = tokens[i][0], tokens[j - 1][1]
            if KINDS[k] == "email" and (whole := _grown(text, *span)) != span and len(_TOKEN.findall(text, *whole)) > MAX_TOKENS:
                span = whole
                while more and more[-1][1] > span[0] and more[-1][0] >= tokens[0][0]:
                    more.pop()  # guesses at parts of the same address
            if span[0] >= end:
                more.append((*span, KINDS[k]))
                end = span[1]
    found = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in more]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spans_column(text: Column, spark) -> Column:
    """Array of (kind, start, end, base) in code points; null texts, and those in which nothing can start a base span or a zone, never reach Python."""
    weights = spark.sparkContext.broadcast(trained_weights())
    known: dict = {}

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        own = weights.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        rows = [[] if t is None else [{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in find_spans(t, own, known)] for t in texts.to_pylist()]
        out = pa.array(rows, kind)
        del rows
        release_memory()
        return out

    return spans(F.when(text.rlike(_TRIGGER_PATTERN), text))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add an array column of spans to every row.

    Null and empty texts have none; repeated rows are judged alike; whole texts are
    read, however long.  A segment has at most ``MAX_TOKENS`` tokens; an address, the only kind
    that can be longer, is grown over the rest of its local part and domain where the whole has more.  Of
    segmentations that score alike the one of shorter segments wins;
    a column named like ``out`` is replaced and all other columns stay.
    """
    return docs.withColumn(out, spans_column(F.col(text_col), docs.sparkSession))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, joined with those that overlap it, replaced by <KIND> of the first of them; null texts stay null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), found.to_pylist()):
            if t is not None and own:
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return F.when(F.size(spans) > 0, clean(text, spans)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
