"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans they miss.

The base finds emails, IP addresses, payment cards and phone numbers by pattern and check. The field looks at regions: a chain
of digit groups and separators, or what stands around a mark of an email (`@`, or the word at, alone or in brackets) as far as names and
hosts go. A region is segmented: a segment is one atom (a run of letters or of digits, or one other character)
outside, or an entity of one kind. An entity is scored by features of the whole span (how many digits and groups, which separators,
what mark, how many labels and which suffix a host has, what word stands in front, what is left over on both sides), labels by
a transition matrix; dynamic programming over (end, kind) picks boundaries and kinds together. Elsewhere a text has no
candidate, so all of it is outside and need not be walked.

A candidate is a possible value of a kind (of at most MAX_DIGITS digits in MAX_GROUPS groups), or has a name of MAX_NAME and a host of MAX_HOST characters, which are the limits of the
formats themselves; it may have any number of atoms, and a region reaches as far as its chain does.

It is trained on base spans as given labels, in at most TRAIN_EXCERPTS excerpts of about TRAIN_TEXTS texts (as many with a digit or sign,
half as many with the word at), at most TEXT_EXCERPTS of one text, all chosen by hashes. Each text teaches as it stands; TURNS times with
its spans rewritten in other forms, with names, hosts and groups drawn anew, so that no name or shape is learned by heart; and as often with
its spans replaced by what only looks like one (dates, versions, lists of numbers, wrong check digits, words before and behind an at).
Predicted spans that touch no base span and are possible values of their kind are added.

Defined results
- Null and empty texts: no spans. No base span in the sample: nothing is learned and nothing added.
- Positions count code points, end exclusive. Repeated rows are each answered. Very long texts are read whole.
- Ties between segmentations: the first label in the order outside, email, ip, card, phone, then the longest segment.
- Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of
from .word_cache import text_runs

KINDS = ("email", "ip", "card", "phone")
TRAIN_TEXTS = 600
TRAIN_EXCERPTS = 600
TEXT_EXCERPTS = 4
#: Times each text is rewritten, and spoiled; regions that teach, at most.
TURNS, TRAIN_REGIONS = 12, 2_400
EPOCHS = 8
#: Limits of the formats: digits and groups of a number, characters of an email's name and host.
MAX_DIGITS, MAX_GROUPS, MAX_NAME, MAX_HOST = 19, 8, 64, 253

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
#: Groups of digits and what may stand between two of them: separators, brackets, the word dot.
_BETWEEN = r"[ \u00a0]?(?:[-./_\u2010-\u2013]|[(\[][.]?[)\]]?|[)\]]|(?:[(\[]?(?i:dot)[)\]]?))?[ \u00a0]?[(]?"
_CHAIN = re.compile(rf"(?:\+|\(\+?)?[0-9]+(?:{_BETWEEN}[0-9]+)+|\+?[0-9]{{7,}}")
#: An email's mark with the spaces around it, and a dot within a name or host.
_MARK = re.compile(r"[ ]?(?:@|[(\[{<] ?(?i:at|@) ?[)\]}>])[ ]?|[ ](?i:at)[ ]")
_DOT = r"(?:\.|[ ]?[(\[{<] ?(?i:dot|\.) ?[)\]}>][ ]?|[ ](?i:dot)[ ])"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
#: The end of a name, read backwards from the mark.
_BACK = re.compile(r"(?:[A-Za-z0-9_%+.-]|[ ](?i:tod)[ ](?=[A-Za-z0-9])|[ ]?[)\]}>] ?(?i:tod|\.) ?[(\[{<][ ]?(?=[A-Za-z0-9]))+")
_JOINTS = re.compile(_DOT)
_TRIGGER = re.compile(r"[0-9]|@|(?i:\bat\b)")
# Suffixes of hosts that are met most, words that stand before an at without being a name, and words that name what follows.
SUFFIXES = frozenset("com org net edu gov mil int info biz name pro io co ai app dev me tv cc uk de fr es it nl be ch at se no fi dk pl cz pt gr ie eu ru ua tr us ca mx br ar cl au nz jp cn kr in sg hk za il example test invalid".split())
COMMON = frozenset("a an and are arrive arrived available be been bought by can come eat find for found go good have he held hello her him home host hosted i is it join kept live lives look looked looking me meet met not now of on one open or out read remain run runs sat see seen she sell shop sign site sold start stay stop that the them there they this to up us visit was we were work worked working works you".split())
CUES = {"phone": "phone tel telephone call calls called calling mobile cell fax ring dial whatsapp sms text number", "card": "card visa mastercard amex credit debit pay payment billing charge charged", "ip": "ip host server address ping ssh addr dns gateway", "email": "mail email e-mail contact write reach send to at address", "other": "version release isbn page pages chapter year years from order invoice no nr ref id build section total sum price cost between figures scores"}
_CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}

Span = tuple[int, int, str]
Place = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    found: list[Span] = []
    at, upto = text.find("@"), 0
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _number_spans(text: str, a: int, b: int) -> list[Place]:
    """(start, end) of candidates among the groups of a chain: from a group, or the sign or bracket in front of it, to a later one."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text[a:b])]
    out = []
    for i, (s, _) in enumerate(groups):
        starts = [s]
        if s and text[a + s - 1] in "+(" and a + s - 1 >= a:
            starts.append(s - 1)
            if s > 1 and text[a + s - 2 : a + s] == "(+":
                starts.append(s - 2)
        digits = 0
        for j in range(i, min(i + MAX_GROUPS, len(groups))):
            digits += groups[j][1] - groups[j][0]
            if digits > MAX_DIGITS:
                break
            phone, card = 7 <= digits <= 15 and j > i, 13 <= digits and luhn(_digits(text[a + s : a + groups[j][1]]))
            if phone or card or j - i == 3 and all(y - x <= 3 and int(text[a + x : a + y]) <= 255 for x, y in groups[i : j + 1]):
                out += [(a + x, a + groups[j][1]) for x in starts]
    return out


def _email_spans(text: str, mark: re.Match) -> list[Place]:
    """Candidates around a mark: names that end before it, with hosts of two labels or more that begin behind it."""
    host = _HOST.match(text, mark.end(), min(len(text), mark.end() + MAX_HOST))
    before = text[max(0, mark.start() - MAX_NAME) : mark.start()]
    name = _BACK.match(before[::-1])
    if not host or not name or not before[-1].isalnum() and before[-1] not in "_%+-":
        return []
    first = mark.start() - name.end()
    starts = [m.start() for m in _ATOM.finditer(text, first, mark.start()) if text[m.start()].isalnum()]
    ends = [m.start() for m in list(_JOINTS.finditer(text, host.start(), host.end()))[1:]] + [host.end()]
    # A host may go on with a sentence's next word behind its full stop: every label but the first may be the last.
    return [(s, e) for s in starts for e in ends]


def regions(text: str) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(atoms, candidates) of the stretches that hold candidates; atoms are (start, end) in the text, candidates (first, last) atoms."""
    spans: set[Place] = set()
    for m in _CHAIN.finditer(text):
        spans.update(_number_spans(text, m.start(), m.end()))
    for m in _MARK.finditer(text):
        spans.update(_email_spans(text, m))
    merged: list[list] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
            merged[-1][2].append((s, e))
        else:
            merged.append([s, e, [(s, e)]])
    for s, e, inside in merged:
        atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text, s, e)]
        starts, ends = {a: k for k, (a, _) in enumerate(atoms)}, {b: k for k, (_, b) in enumerate(atoms)}
        yield atoms, [(starts[a], ends[b]) for a, b in inside if a in starts and b in ends]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n > e for e in edges)


def _cue(text: str, start: int) -> str:
    """What the last two words in front say of what follows."""
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 30) : start].lower())[-2:]
    return next((_CUE_OF[w] for w in reversed(words) if w in _CUE_OF), "none")


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of one candidate as a whole."""
    s = text[start:end]
    mark = _MARK.search(s)
    if mark and any(c.isalpha() for c in s[mark.end() :]):
        return _email_features(text, start, end, mark)
    d, groups = _digits(s), [len(g) for g in re.findall("[0-9]+", s)]
    seps = re.sub("[0-9+]", "", s)
    kinds = {"dot" if c.lower() in "dot" else "space" if c in " \u00a0" else c for c in seps if c not in "()[]"}
    more = lambda m: m is not None
    left, right = text[max(0, start - 6) : start], text[end : end + 6]
    values = [int(g) for g in re.findall("[0-9]+", s)]
    octets = len(groups) == 4 and all(n <= 3 and v <= 255 for n, v in zip(groups, values))
    date = bool(re.fullmatch(r"(?:(?:1[5-9]|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./][0-3]?[0-9]|[0-3]?[0-9][-./][0-3]?[0-9][-./](?:1[5-9]|20)[0-9]{2})(?: [0-2]?[0-9].*)?", s))
    years = sum(n == 4 and 1500 <= v <= 2100 for n, v in zip(groups, values))
    card = 13 <= len(d) <= 19 and luhn(d)
    return [
        "number", f"digits={_bucket(len(d), (6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 19))}", f"groups={min(len(groups), 7)}", f"largest={min(max(groups), 9)}", f"least={min(min(groups), 4)}",
        f"seps={'|'.join(sorted(kinds))[:12]}", f"one_sep={len(kinds) <= 1}", f"card={card}", f"card_even={card and len(groups) > 1 and set(groups[:-1]) == {4}}", f"octets={octets}", f"octet_dots={octets and kinds == {'dot'} or octets and kinds == {'.'}}",
        f"plus={s[0] == '+' or s[:2] == '(+'}", f"brackets={s.count('(')}{s.count(')')}", f"zeros={len(s) - len(s.lstrip('0')) if len(groups) > 1 else 0}", f"date={date}", f"years={min(years, 2)}", f"small={max(groups) <= 2}", f"last={min(groups[-1], 5)}", f"first={min(groups[0], 5)}",
        f"on_left={more(re.search(r'[0-9][-./ ()]{0,2}$', left))}", f"on_right={more(re.match(r'[-./ ()]{0,2}[0-9]', right))}", f"sign_left={left[-1:] in ('+', '(')}", f"glued={left[-1:].isalnum() or right[:1].isalnum()}", f"money={left[-1:] in ('$', '€', '£') or left[-2:-1] in ('$', '€', '£')}", f"cue={_cue(text, start)}", f"cue_card={_cue(text, start)}{card}",
    ]


def _email_features(text: str, start: int, end: int, mark: re.Match) -> list[str]:
    s = text[start:end]
    name, host = s[: mark.start()], s[mark.end() :]
    labels = _JOINTS.split(host)
    suffix = labels[-1].lower()
    after, before = text[end : end + 8], text[max(0, start - 8) : start]
    kind = "sign" if mark[0].strip() == "@" else "word" if mark[0].strip().lower() == "at" else "bracket"
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", name) if p]
    plain = len(parts) == 1 and parts[0].isalpha() and len(name) == len(parts[0])
    return [
        "email", f"mark={kind}", f"mark_space={mark[0] != mark[0].strip()}", f"labels={min(len(labels), 5)}", f"suffix={suffix in SUFFIXES}", f"suffix_letters={suffix.isalpha()}{_bucket(len(suffix), (1, 3, 6))}", f"written={'dot' in host.lower().split() or '(' in host or '[' in host}",
        f"plain={plain}{kind}", f"common={name.lower() in COMMON}{kind}", f"name={_bucket(len(name), (1, 2, 4, 8, 16))}", f"digit={any(c.isdigit() for c in name)}", f"marks={any(c in '._+-' for c in name)}", f"capital={name[:1].isupper()}{plain}",
        f"rest_left={before[-1:] in _LOCAL and before[-1:] != ''}", f"dot_left={bool(re.search(r'[ (]dot[ )]+$', before, re.I))}", f"rest_right={bool(re.match(r'[A-Za-z0-9_-]', after))}", f"dot_right={bool(re.match(r'[.][A-Za-z0-9]', after))}", f"word_right={bool(re.match(r'[ ]?[(]?dot', after, re.I))}",
        f"label={_bucket(max(map(len, labels)), (1, 3, 12))}", f"cue={_cue(text, start)}{kind}", f"upper={suffix != labels[-1]}",
    ]


@dataclass
class Field:
    """Weights: features x kinds, and transitions between labels (0: outside)."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def scores(self, text: str, atoms: list[tuple[int, int]], segments: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros((len(segments), len(KINDS)))
        for r, (i, j) in enumerate(segments):
            at = [k for f in span_features(text, atoms[i][0], atoms[j][1]) if (k := self.index.get(f)) is not None]
            out[r] = self.weights[at].sum(axis=0)
        return out

    def decode(self, text: str) -> list[Span]:
        """Best segmentation of each region; its entities."""
        out: list[Span] = []
        if not len(self.weights):
            return out
        for atoms, segments in regions(text):
            scores = self.scores(text, atoms, segments)
            by_end: dict[int, list[int]] = {}
            for r, (_, j) in enumerate(segments):
                by_end.setdefault(j, []).append(r)
            best = np.full((len(atoms) + 1, len(KINDS) + 1), -np.inf)
            best[0, 0] = 0.0
            back: list[list[tuple[int, int] | None]] = [[None] * (len(KINDS) + 1) for _ in range(len(atoms) + 1)]
            for e in range(1, len(atoms) + 1):
                p = int(np.argmax(best[e - 1] + self.moves[:, 0]))
                best[e, 0] = best[e - 1, p] + self.moves[p, 0]
                back[e][0] = (e - 1, p)
                for r in by_end.get(e - 1, ()):
                    i = segments[r][0]
                    reach = best[i][:, None] + self.moves[:, 1:]
                    p = reach.argmax(axis=0)
                    total = reach[p, np.arange(len(KINDS))] + scores[r]
                    for k in np.flatnonzero(total > best[e, 1:]):
                        best[e, k + 1] = total[k]
                        back[e][k + 1] = (i, int(p[k]))
            e, label = len(atoms), int(best[len(atoms)].argmax())
            while e:
                i, before = back[e][label]
                if label:
                    out.append((atoms[i][0], atoms[e - 1][1], KINDS[label - 1]))
                e, label = i, before
        return out


def _rewritten(text: str, gold: list[Span], write) -> tuple[str, list[Span]]:
    """The text with each span written anew by write(kind, span, its hash) -> (what stands in front, string, whether it still is one), and where the spans are then."""
    out, spans, upto, size = [], [], 0, 0
    for a, b, kind in gold:
        if a < upto:
            continue
        front, s, stays = write(kind, text[a:b], zlib.crc32(text[a:b].encode()))
        out += [text[upto:a], front, s]
        size += a - upto + len(front)
        if stays:
            spans.append((size, size + len(s), kind))
        size += len(s)
        upto = b
    return "".join([*out, text[upto:]]), spans


_SYLLABLES = "ba be bo da de di fa fe ga ha hu ja jo ka ki la le lo ma mi mo na ne no pa pe ra ri ro sa se so ta te ti to va ve vi wa ya za".split()


class _Draw:
    """Choices that a hash decides, one after the other."""

    def __init__(self, seed: int):
        self.state = seed

    def upto(self, n: int) -> int:
        self.state = zlib.crc32(self.state.to_bytes(4, "little"), 77)
        return self.state % n

    def of(self, *options):
        return options[self.upto(len(options))]

    def word(self) -> str:
        return "".join(_SYLLABLES[self.upto(len(_SYLLABLES))] for _ in range(1 + self.upto(4)))

    def digits(self, n: int) -> str:
        return "".join(str(self.upto(10)) for _ in range(n))

    def cue(self, kind: str) -> str:
        """Half of the time, a word that names the kind."""
        return f"{self.of(*CUES[kind].split())}{self.of('', ':', '', '.')} " if self.upto(2) else ""

    def name(self) -> str:
        parts = [self.word() for _ in range(self.of(1, 1, 2, 2, 3, 4))]
        out = self.of(".", ".", "_", "-").join(parts) + self.of("", "", str(self.upto(100)), f"_{self.upto(10)}")
        return self.of(out, out, out.title(), f"{out}+{self.word()}")

    def host(self) -> str:
        return ".".join(self.of(self.word(), f"{self.word()}-{self.word()}", f"{self.word()}{self.upto(10)}") for _ in range(self.of(1, 1, 1, 2, 3))) + "." + self.of(*sorted(SUFFIXES))


def _grouped(draw: _Draw, digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(x for x in (*out, digits[at:]) if x)


def _weakened(text: str, gold: list[Span], turn: int = 0) -> tuple[str, list[Span]]:
    """The text with its spans in other forms; some with names, hosts and numbers of their own."""

    def write(kind: str, s: str, seed: int) -> tuple[str, str, bool]:
        draw = _Draw((seed + 7919 * turn) & 0xFFFFFFFF)
        if kind == "email":
            name, _, host = s.rpartition("@")
            if draw.upto(4):
                name, host = draw.name(), draw.host()
            mark = draw.of(" at ", " at ", " AT ", " (at) ", "(at)", " [at] ", "[at]", " @ ", "{at}")
            dot = draw.of(".", ".", " dot ", " dot ", " (dot) ", "[dot]", " DOT ")
            if dot != "." and draw.upto(3) == 0:
                name = name.replace(".", dot)
            return draw.cue("email"), f"{name}{mark}{host.replace('.', dot)}", True
        if kind == "phone":
            n = draw.of(7, 8, 9, 10, 10, 10, 11)
            d = str(1 + draw.upto(9)) + draw.digits(n - 1)
            sep = draw.of(" ", " ", "-", "-", ".", "/")
            body = _grouped(draw, d, draw.of((3, 3, 4), (3, 4, 4), (2, 4, 4), (3, 3, 2, 2), (2, 3, 2, 2), (4, 3, 3), (3, 4), (4, 4), (5, 5), (2, 2, 2, 2, 2)), sep)
            front = draw.of("", "", "0", f"00{1 + draw.upto(99)}{sep}", f"00{1 + draw.upto(99)}{sep}(0)", f"({draw.digits(3)}) ", f"({draw.digits(3)})", f"(0{draw.digits(draw.of(2, 3, 4))}) ", f"{1 + draw.upto(9)}{sep}", f"(+{1 + draw.upto(99)}) ")
            return draw.cue("phone"), front + body, True
        if kind == "card":
            d = _digits(s)
            return draw.cue("card"), draw.of(".", "/", "_", " - ", ".", "\u00a0").join(d[k : k + 4] for k in range(0, len(d), 4)), True
        parts = [str(draw.upto(draw.of(256, 256, 100, 10))) for _ in range(4)]
        return draw.cue("ip"), draw.of("[.]", "(.)", " . ", " dot ", "[dot]", "[.]").join(parts), True

    return _rewritten(text, gold, write)


def _spoiled(text: str, gold: list[Span], turn: int = 0) -> tuple[str, list[Span]]:
    """The text with what only looks like a value in its spans' place; none is left."""

    def write(kind: str, s: str, seed: int) -> tuple[str, str, bool]:
        draw = _Draw((seed + 7919 * turn) & 0xFFFFFFFF)
        d = _digits(s)
        if kind == "ip":
            parts = s.split(".")
            parts[draw.upto(4)] = str(256 + draw.upto(700))
            three = ".".join(str(draw.upto(30)) for _ in range(3))
            return draw.cue("other"), draw.of(".".join(parts), "[.]".join(parts), f"version {three}", f"build {three}.{draw.digits(5)}", f"section {three}.{draw.upto(9)}.{draw.upto(9)}"), False
        if kind == "card":
            wrong = s[:-1] + str((int(s[-1]) + 1 + draw.upto(8)) % 10)
            wrong_d = _digits(wrong)
            return draw.cue("other"), draw.of(wrong, ".".join(wrong_d[k : k + 4] for k in range(0, 16, 4)), f"978-{draw.upto(10)}-{draw.digits(2)}-{draw.digits(6)}-{draw.upto(10)}", f"order {draw.digits(12)}", f"id {draw.digits(9)}-{draw.digits(5)}"), False
        if kind == "phone":
            year = 1900 + draw.upto(130)
            day = f"{year}-{1 + draw.upto(12):02d}-{1 + draw.upto(28):02d}"
            some = [str(draw.upto(draw.of(100, 60, 1000, 10))) for _ in range(draw.of(4, 5, 6, 8, 12))]
            return draw.cue("other"), draw.of(
                f"{d[-6:-4]}-{d[-4:]}", f"+{d[:3]} {d[3:6]}", d[:5], day, f"{day} {draw.upto(24):02d}.{draw.upto(60):02d}", f"{1 + draw.upto(28)}.{1 + draw.upto(12)}.{year}", f"{day}/{day}", f"{year}-{year + 3}", f"years {year} {year + 1} {year + 2}",
                " ".join(some), "-".join(some[:4]), f"pages {draw.upto(400)}-{draw.upto(999)}", f"{1 + draw.upto(9)}.{draw.digits(3)}.{draw.digits(3)}", f"$ {draw.digits(3)} {draw.digits(3)} {draw.digits(3)}", f"0.{draw.digits(8)}", draw.digits(draw.of(8, 10, 12)), f"{draw.digits(2)} {draw.digits(2)} {draw.digits(2)} {draw.digits(2)}",
            ), False
        common = sorted(COMMON)
        word = common[draw.upto(len(common))]
        return "", draw.of(f"{draw.word()} at {draw.word()}", f"{word} at {draw.word()}.{draw.word()}", f"{word} at {draw.host()}", f"{word} at {draw.word()}. {draw.word().title()}", f"{draw.word()} at {draw.word()}.{draw.word().title()} {draw.word()}", f"@{draw.word()}", f"{draw.word()} @ {draw.word()}", f"{word} at {draw.upto(24)}.{draw.upto(60):02d}", f"{draw.name()} at {draw.word()}"), False

    return _rewritten(text, gold, write)


def _possible(kind: str, s: str) -> bool:
    """Whether a span can be a value of its kind."""
    d = _digits(s)
    if kind == "email":
        mark = _MARK.search(s)
        host = _HOST.fullmatch(s, mark.end()) if mark else None
        return host is not None and bool(re.search("[A-Za-z]", _JOINTS.split(host[0])[-1])) and _JOINTS.sub(".", s[: mark.start()]).isascii()
    if any(c.isalpha() for c in re.sub("(?i)dot", "", s)):
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and len(re.findall("[0-9]+", s)) > 1


def _example(text: str, atoms: list[Place], segments: list[Place], gold: list[Span]) -> tuple[list, list, list] | None:
    """(segments, features, labelled path) of a region; None if a span is no candidate."""
    starts, ends = {a: k for k, (a, _) in enumerate(atoms)}, {b: k for k, (_, b) in enumerate(atoms)}
    path: list[tuple[int, int, int]] = []
    at = 0
    known = set(segments)
    for a, b, kind in gold:
        if not atoms or b <= atoms[0][0] or a >= atoms[-1][1]:
            continue
        if a not in starts or b not in ends or (starts[a], ends[b]) not in known or starts[a] < at:
            return None
        path += [(k, k, 0) for k in range(at, starts[a])] + [(starts[a], ends[b], KINDS.index(kind) + 1)]
        at = ends[b] + 1
    path += [(k, k, 0) for k in range(at, len(atoms))]
    return segments, [span_features(text, atoms[i][0], atoms[j][1]) for i, j in segments], path


def train_field(texts: list[str], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by AdaGrad on the regions of the texts, in the order given."""
    examples = []
    given = []
    for text in texts:
        gold: list[Span] = []
        for s in base_spans(text):
            if not gold or s[0] >= gold[-1][1]:
                gold.append(s)
        given.append((text, gold))
    known = [g for g in given if g[1]]
    versions = chain(given, (f(*g, turn) for turn in range(TURNS) for g in known for f in (_weakened, _spoiled)))
    for t, g in versions:
        for atoms, segments in regions(t):
            near = [s for s in g if s[0] < atoms[-1][1] and s[1] > atoms[0][0]]
            inside = [s for s in near if s[0] >= atoms[0][0] and s[1] <= atoms[-1][1]]
            if len(inside) == len(near) and (ex := _example(t, atoms, segments, inside)) is not None:
                examples.append((len(atoms), *ex))
        if len(examples) >= TRAIN_REGIONS:
            break
    if not any(label for ex in examples for *_, label in ex[3]):
        return Field()
    index: dict[str, int] = {}
    ready = []
    for n, segments, features, path in examples:
        ready.append((n, segments, [np.array([index.setdefault(f, len(index)) for f in fs]) for fs in features], path))
    K = len(KINDS)
    model = Field(index, np.zeros((len(index), K)), np.zeros((K + 1, K + 1)))
    gw, gm = np.full_like(model.weights, 1e-2), np.full_like(model.moves, 1e-2)
    for _ in range(epochs):
        for n, segments, features, path in ready:
            scores = np.array([model.weights[f].sum(axis=0) for f in features])
            dw, dm = _gradient(n, segments, scores, path, model.moves)
            grad: dict[int, np.ndarray] = {}
            for r, f in enumerate(features):
                if np.abs(dw[r]).max() > 1e-6:
                    for k in f.tolist():
                        grad[k] = grad.get(k, 0.0) + dw[r]
            for k, g in grad.items():
                g = g - 1e-4 * model.weights[k]
                gw[k] += g * g
                model.weights[k] += 0.3 * g / np.sqrt(gw[k])
            gm += dm * dm
            model.moves += 0.3 * dm / np.sqrt(gm)
    return model


def _gradient(n: int, segments: list[tuple[int, int]], scores: np.ndarray, path: list[tuple[int, int, int]], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled minus expected counts of each segment's kinds and of the moves, by forward and backward sums."""
    K = len(KINDS)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for r, (i, j) in enumerate(segments):
        by_end.setdefault(j + 1, []).append(r)
        by_start.setdefault(i, []).append(r)
    total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    a = np.full((n + 1, K + 1), -np.inf)
    a[0, 0] = 0.0
    for e in range(1, n + 1):
        a[e, 0] = total(a[e - 1] + moves[:, 0], 0)
        for r in by_end.get(e, ()):
            a[e, 1:] = np.logaddexp(a[e, 1:], total(a[segments[r][0]][:, None] + moves[:, 1:], 0) + scores[r])
    b = np.full((n + 1, K + 1), -np.inf)
    b[n] = 0.0
    for s in range(n - 1, -1, -1):
        b[s] = moves[:, 0] + b[s + 1, 0]
        for r in by_start.get(s, ()):
            b[s] = np.logaddexp(b[s], total(moves[:, 1:] + (scores[r] + b[segments[r][1] + 1, 1:])[None, :], 1))
    z = total(a[n], 0)
    dw, dm = np.zeros((len(segments), K)), np.zeros_like(moves)
    for r, (i, j) in enumerate(segments):
        joint = np.exp(a[i][:, None] + moves[:, 1:] + (scores[r] + b[j + 1, 1:])[None, :] - z)
        dw[r] -= joint.sum(axis=0)
        dm[:, 1:] -= joint
    for s in range(n):
        dm[:, 0] -= np.exp(a[s] + moves[:, 0] + b[s + 1, 0] - z)
    place = {s: r for r, s in enumerate(segments)}
    before = 0
    for i, j, label in path:
        if label:
            dw[place[i, j], label - 1] += 1
        dm[before, label] += 1
        before = label
    return dw, dm


def all_spans(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and added ones), each by start, then kind as listed."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    ends = np.array([b for _, b in taken])
    top = np.maximum.accumulate(ends) if len(ends) else ends
    starts = np.array([a for a, _ in taken])

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b))
        return k == 0 or int(top[k - 1]) <= a

    added = [s for s in model.decode(text) if free(s[0], s[1]) and _possible(s[2], text[s[0] : s[1]])]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS) -> Field:
    """Train on excerpts of about train_texts texts with a digit or an at sign, and of half as many with the word at."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = {"sign": ("[0-9@]", train_texts), "word": (r"\b[aA][tT]\b", train_texts // 2)}
    counts = base.agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, (p, _) in kinds.items()]).first()
    place = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30))
    some = None
    for kind, (pattern, texts) in kinds.items():
        upto = (1 << 30) if counts[kind] <= texts else int(texts / counts[kind] * (1 << 30))
        excerpts = F.regexp_extract_all("text", F.lit(rf"(?s).{{0,60}}{pattern}.{{0,90}}"), F.lit(0))
        one = base.where(place < upto).where(F.col("text").rlike(pattern)).select(F.lit(kind).alias("kind"), F.transform(excerpts, lambda x: F.struct(F.xxhash64(x, F.lit(7)).alias("h"), x.alias("x"))).alias("found"))
        some = one if some is None else some.unionByName(one)
    picked = some.select("kind", F.explode(F.slice(F.array_sort("found"), 1, TEXT_EXCERPTS)).alias("e")).select("kind", "e.h", "e.x")
    rows = picked.orderBy("h", "x").limit(TRAIN_EXCERPTS).collect()
    return train_field([r["x"] for r in rows])


def find_spans(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans (arrays of kind, start, end) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                both = [all_spans(t, shared.value) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([rows(x) for x, _ in both], kind), pa.array([rows(y) for _, y in both], kind)], names=[id_col, "base", "spans"])

    base = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    span = "array<struct<kind: string, start: long, end: long>>"
    return base.mapInArrow(find, f"`{id_col}` {dict(base.dtypes)[id_col]}, base {span}, spans {span}")
