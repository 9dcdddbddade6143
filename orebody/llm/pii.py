"""Personal information in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

Features of a token are word shapes: the case of its letters, its number of digits, whether it is on the list of names, an
ordinary or a proper word in the vocabulary of a public tokenizer, and a cue of some class (titles, roles, words for places,
firms, streets, numbers of persons and of things); the same of its neighbours; and, for tokens of what looks like an address
of some kind or a number, the outline of the whole and the cues around it. Only words that stand in several sentences of
the training table are features themselves, so the field does not learn the table by heart. It is trained by gradient
steps on the log-likelihood (forward-backward in numpy) and decoded by Viterbi over batches of texts; tokens that
no path through another label can win are cut out first, by a bound that keeps the result exact.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import inspect
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm import pii_table
from orebody.llm.pii_table import CUES, KINDS, labelled_rows
from orebody.operators.skew import TASK, plan_load, skew_join
from orebody.plans.session import materialise, shared_folder

TRAIN_ROWS = 4500
#: Rounds of gradient steps over the rows, and the rows of a step.
ROUNDS, _PART_ROWS = 8, 250
#: Sentences of the training table in which a word must stand to be a feature itself.
KNOWN_IN = 5
#: Longer lists of names are joined to the texts' words instead of being sent to the tasks.
MOST_NAMES = 200_000
#: Vocabularies of public tokenizers; the words in them tell ordinary from proper words.
LEXICON = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PAD = 3
_OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_NEAR = 9
_BATCH = 2000
_CACHE_WORDS = 100_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
# The outer form of chunks. Whether one is personal, and of which kind, is left to the field.
_B = "[ \\u00a0\\u202f\\u2009\\t]"
_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w(?:@|＠|" + _B + r"?[(\[{]" + _B + r"?(?:at|@|ät)" + _B + r"?[)\]}]" + _B + "?|" + _B + "@" + _B + r")[\w-]+(?:(?:\.|" + _B + r"?[(\[{]" + _B + r"?(?:dot|\.|punkt|punto|point)" + _B + r"?[)\]}]" + _B + r"?|" + _B + "dot" + _B + r")[\w-]+)+", re.I,
)
_EMAIL_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]*\w" + _B + "(?:at|arroba)" + _B + r"(?!www\.)[\w-]+(?:(?:" + _B + "(?:dot|punto)" + _B + r"|\.)[\w-]+)+(?![\w.+-]*" + _B + r"?[@＠(\[{])", re.I)
#: An address has at most 254 signs, 64 of them before the @ (RFC 5321); with signs and blanks around.
_BEFORE, _AFTER = 100, 300
_STREET = "|".join(sorted((w for w in CUES["street"].split() if w not in "rue chemin quai allée impasse cours route calle avenida plaza paseo camino ronda cuesta travesía straße strasse weg gasse allee platz damm ufer".split()), key=len, reverse=True))
_UNIT = r"(?:\.?,?" + _B + r"*(?:(?:apt|unit|suite|ste|apartment|flat)\b\.?" + _B + r"*#?\w{1,5}|\#" + _B + r"?\w{1,5}))?"
_NAMED = r"(?:\d{1,3}(?:st|nd|rd|th)\b|[^\W\d_]{1,3}\.|[^\W\d_][\w'’-]*)"
_STREET_FIRST = re.compile(
    r"\d{1,4}(?:" + _B + r"?(?:bis|ter|[a-d]\b))?,?" + _B + r"+(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours|route|bd|av)\b\.?" + _B + r"+"
    r"(?:(?:de" + _B + r"la|de" + _B + r"l['’]|des|du|de|d['’]|la|le|les)" + _B + r"*)?[^\W\d_][\w'’-]*(?P<tail>(?:" + _B + r"+[^\W\d_][\w'’-]*){0,2})"
    r"|\d{1,5}(?:-?[a-z])?,?" + _B + r"+(?:" + _NAMED + _B + r"+){1,4}?(?:" + _STREET + r")\b(?!['’-]\w)(?:" + _B + r"+(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)\b)?" + _UNIT, re.I,
)
_STREET_CAPITALS = re.compile(r"\d{1,5}(?:-?[A-Da-d])?" + _B + r"+[A-ZÀ-Ý][a-zß-ÿ'’-]+(?P<tail>(?:" + _B + r"+[A-ZÀ-Ý][a-zß-ÿ'’-]+){0,3})" + _UNIT)
_CALLE = frozenset("calle avenida avda plaza paseo camino ronda cuesta travesía c".split())
_STREET_SPANISH = re.compile(r"(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|cuesta|travesía|c/)" + _B + r"+(?:[^\W\d_][\w'’.-]*,?" + _B + r"+){1,6}?(?:n[.º°o]*" + _B + r"*)?\d{1,4}(?:-?[a-z])?\b", re.I)
_GASSE = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "damm", "ufer", "ring", "steig")
_STREET_GERMAN = re.compile(r"[^\W\d_][\w-]*(?:" + "|".join(_GASSE) + r")\.?" + _B + r"+\d{1,4}(?:" + _B + r"?[a-z]\b)?", re.I)
_NUMBER = re.compile(
    r"(?:[a-z]{1,3}[-.]?" + _B + r"?)?\d[\da-z]*(?:(?:[./]|" + _B + r"?[-–]" + _B + r"?)[\da-z]*\d[\da-z]*|" + _B + r"\d{2,}(?![\w'’])|" + _B + r"\d(?=" + _B + r"\d))*(?:-?[a-z]\b)?"
    r"|(?:\+\d{1,3}" + _B + r"?[.-]?)?(?:\(\d{1,5}\)" + _B + r"?[.-]?)?\d+(?:(?:[./]|" + _B + "?[-–]" + _B + r"?)\d+|" + _B + r"\d{2,})*", re.I,
)
#: Two letters, groups of digits, and a letter.
_LETTERED = re.compile(r"[A-Za-z]{1,2}" + _B + r"?\d\d(?:" + _B + r"?\d\d){2,3}" + _B + r"?[A-Za-z]\b")
_PHONE = re.compile(r"(?:\+\d{1,3}" + _B + r"?[.-]?)?(?:\(\d{1,5}\)" + _B + r"?[.-]?)?\d+(?:(?:[./]|" + _B + "?[-–]" + _B + r"?)\d+|" + _B + r"\d{2,})*")


def shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 11)}"
    if not word[0].isalpha():
        return word
    if len(word) == 1:
        return "X" if word.isupper() else "x"
    return "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx"


_CUES_OF: dict[str, tuple[str, ...]] = defaultdict(tuple)
for _kind, _words in CUES.items():
    for _word in dict.fromkeys(_words.split()):
        _CUES_OF[_word] += (_kind,)
_CUES_OF = dict(_CUES_OF)
#: Cues that say of which kind a number or an address is.
_OF_CHUNK = frozenset(("id", "code", "phone", "live"))


def lexicon(paths: tuple[str, ...] = LEXICON) -> dict[str, str]:
    """Lower-cased words of the vocabularies: o for ordinary words, p for those that are more frequent with a capital. As many
    entries as the vocabularies have words, which bounds what is sent to the tasks."""
    out: dict[str, str] = {}
    for path in paths:
        low, cap = {}, {}
        with open(path, "rb") as f:
            for rank, line in enumerate(f):
                word = base64.b64decode(line.split()[0])
                if word[:1] == b" " and len(word) > 2:
                    text = word[1:].decode("utf-8", "ignore")
                    if text.isalpha():
                        if text.islower():
                            low[text] = rank
                        elif text[0].isupper() and text[1:].islower():
                            cap[text.lower()] = rank
        for w in low.keys() | cap.keys():
            kind = "o" if low.get(w, 1 << 30) < cap.get(w, 1 << 30) else "p"
            out[w] = "o" if "o" in (kind, out.get(w)) else "p"
    return out


def _outline(piece: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", piece))[:24]


# 0 white space, 1 letters, 2 digits, 3 any other sign: what _TOKEN tells apart
_CLASS = np.full(0x110000, 3, np.uint8)
for _c in range(0x110000):
    _s = chr(_c)
    if _s.isspace():
        _CLASS[_c] = 0
    elif _s.isdecimal():
        _CLASS[_c] = 2
    elif _s.isalnum():
        _CLASS[_c] = 1


@functools.lru_cache(_CACHE_WORDS)
def _mark(word: str) -> int:
    """1 for what stands for an @, 2 for what begins a Spanish street, 3 for what ends a German one's name, else 0."""
    low = word.lower()
    return 1 if low in ("at", "arroba") else 2 if low in _CALLE else 3 if len(low) > 2 and low.endswith(_GASSE) else 0


@functools.lru_cache(_CACHE_WORDS)
def _is_street(word: str) -> bool:
    return "street" in _CUES_OF.get(word.lower(), ()) or word.lower() in ("bd", "av")


class Texts:
    """Tokens of a batch of texts on one axis, with PAD empty tokens before, between and after them."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        sign = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _CLASS[sign]
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        before = np.concatenate(([0], kind[:-1])) if len(kind) else kind
        starts = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 3)))
        after = np.concatenate((kind[1:], [0])) if len(kind) else kind
        ends = np.flatnonzero((kind > 0) & ((kind != after) | (kind == 3))) + 1
        words = _TOKEN.findall(joined)
        if len(words) != len(starts):
            raise ValueError("signs are classed in two ways")
        owner = np.searchsorted(base, starts, side="right") - 1
        n = len(starts)
        per = np.bincount(owner, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
        self.at = np.arange(n) + PAD * (owner + 1)
        self.size = n + PAD * (len(texts) + 1)
        self.first = (np.cumsum(per) - per + PAD * (np.arange(len(texts)) + 1)).astype(np.int64)
        self.sizes = per.astype(np.int64)
        self.start, self.end = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.start[self.at], self.end[self.at] = starts - base[owner], ends - base[owner]
        lines = np.concatenate(([0], np.cumsum(sign == 10)))
        gap = np.ones(n, np.int8)
        if n:
            previous = np.concatenate(([0], ends[:-1]))
            gap[starts == previous] = 0
            gap[lines[starts] > lines[previous]] = 2
            gap[np.flatnonzero(np.diff(owner, prepend=-1))] = 3
        self.gaps = np.full(self.size, 3, np.int8)
        self.gaps[self.at] = gap
        # numbers of the distinct words, 0 for none
        of: dict[str, int] = dict.fromkeys(words, 0)
        self.distinct = ["", *of]
        for k, w in enumerate(of, 1):
            of[w] = k
        self.index = np.zeros(self.size, np.int64)
        plain = np.fromiter(map(of.__getitem__, words), np.int64, n)
        self.index[self.at] = plain
        self.extra: list[tuple[int, str]] = []
        self.inside: dict[str, list[int]] = {"E": [], "A": [], "N": []}
        self.hull: dict[int, tuple[int, int]] = {}
        if n:
            self._chunks(joined, sign, kind, base, owner, starts, ends, words, lines, plain)

    def each(self, of, kind) -> np.ndarray:
        """A value of every distinct word, at its tokens."""
        return np.fromiter((of(w) for w in self.distinct), kind, len(self.distinct))[self.index]

    def _chunks(self, joined, sign, kind, base, owner, starts, ends, words, lines, plain) -> None:
        """What looks like an address or a long number; no overlaps."""
        found: list[tuple[int, int, str, str, int]] = []  # start, end, type, form, start of a part that is not sure
        taken = bytearray(len(joined) + 1)
        lead: dict[int, int] = {}

        def take(m: re.Match | None, what: str, form: str) -> None:
            if m is None or m.end() == m.start() or taken.find(1, m.start(), m.end()) >= 0:
                return
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            tail = m.start("tail") if "tail" in m.re.groupindex and m.group("tail") else m.end()
            found.append((m.start(), m.end(), what, form, tail))

        def low(k: int) -> str:
            return words[k].lower()

        marks = np.fromiter(map(_mark, self.distinct), np.int8, len(self.distinct))[plain]

        signs = np.flatnonzero((sign == 64) | (sign == 0xFF20)).tolist()
        dots = ("dot", "punto", ".")
        spelled = [k for k in np.flatnonzero(marks == 1).tolist() if any(low(i) in dots for i in range(k + 2, min(k + 9, len(words))))]
        for p, form in [(p, _EMAIL) for p in signs] + [(int(starts[k]), f) for k in spelled for f in (_EMAIL, _EMAIL_SPELLED)]:
            # back over what may stand around the sign, then over the part before it
            q = p - 1
            while q >= 0 and p - q < 4 and joined[q] in " \u00a0\u202f\u2009\t([{":
                q -= 1
            least = max(-1, q - _BEFORE)
            while q > least and (joined[q].isalnum() or joined[q] in "._+-"):
                q -= 1
            m = form.match(joined, q + 1, p + _AFTER)
            if m and m.start() <= p < m.end():
                take(m, "E", "@" if "@" in m.group() and " " not in m.group() else "at")
        digit = (kind == 2).astype(np.int32)
        count = np.concatenate(([0], np.cumsum(digit)))
        runs = np.flatnonzero(kind[starts] == 2)

        def number(k: int, s: int, least: int) -> None:
            if taken[s]:
                return
            c, m = joined[s - 1] if s else " ", None
            if c in "(+":
                m = _PHONE.match(joined, s - (2 if c == "(" and s > 1 and joined[s - 2] == "+" else 1))
                if m and c == "(" and ")" not in m.group():
                    m = None
            if m is None:
                a, b = (int(starts[k - 1]), int(ends[k - 1])) if k else (-9, -9)
                if k and kind[a] == 1 and b == s and b - a <= 3:
                    s = a
                elif k > 1 and words[k - 1] in "-." and b == s and kind[starts[k - 2]] == 1 and ends[k - 2] == a and ends[k - 2] - starts[k - 2] <= 3:
                    s = int(starts[k - 2])
                elif k and kind[a] == 1 and b == s - 1 and c in " \u00a0" and b - a <= 3 and words[k - 1].isupper() and not _OF_CHUNK.intersection(_CUES_OF.get(low(k - 1), ())):
                    m = _LETTERED.match(joined, a) or _NUMBER.match(joined, a)
                    if m and sum(map(str.isdigit, m.group())) >= 6:
                        s = a
                c = joined[s - 1] if s else " "
                if c.isalnum() or c in "_$€£@":
                    return
                m = (_LETTERED.match(joined, s) if joined[s].isalpha() else None) or _NUMBER.match(joined, s)
            if m and sum(map(str.isdigit, m.group())) >= least:
                take(m, "N", "number")

        if len(runs):
            p = starts[runs]
            inside = count[np.minimum(p + 30, len(joined))] - count[p]
            for k, s in zip(runs[inside >= 7].tolist(), p[inside >= 7].tolist()):
                number(k, s, 7)
            # a street's word is no farther than the few words that a name of one has
            street = np.append(np.flatnonzero(np.fromiter(map(_is_street, self.distinct), bool, len(self.distinct))[plain]), len(words) + 99)
            near = (street[np.searchsorted(street, runs)] - runs <= 14).tolist()
            short = np.flatnonzero(ends[runs] - p <= 5)
            for k, s in zip(short.tolist(), p[short].tolist()):
                c = joined[s - 1] if s else " "
                if not taken[s] and not (c.isalnum() or c in "_$.,/-€£#@"):
                    m = _STREET_FIRST.match(joined, s) if near[k] else None
                    if m:
                        take(m, "A", "street")
                    else:
                        take(_STREET_CAPITALS.match(joined, s), "A", "capitals")
        for k in np.flatnonzero(marks >= 2).tolist():
            if low(k) in _CALLE:
                take(_STREET_SPANISH.match(joined, int(starts[k])), "A", "calle")
            elif k + 2 < len(words):
                # the name may have parts before a hyphen
                j = k
                while j > 1 and words[j - 1] == "-" and starts[j] == ends[j - 1] and starts[j - 1] == ends[j - 2]:
                    j -= 2
                m = _STREET_GERMAN.match(joined, int(starts[j]))
                if m and taken.find(1, m.start(), m.end()) < 0:
                    # words before may be part of it: am, alte, an der; the field decides
                    i = j
                    while i and j - i < (2 if low(i - 1) in ("der", "dem", "den") else 1) and kind[starts[i - 1]] == 1 and ends[i - 1] == starts[i] - 1 and owner[i - 1] == owner[j] and lines[starts[i - 1]] == lines[starts[j]] and not taken[starts[i - 1]]:
                        i -= 1
                    taken[starts[i] : m.end()] = b"\1" * (m.end() - int(starts[i]))
                    found.append((int(starts[i]), m.end(), "A", "gasse", m.end()))
                    lead[int(starts[i])] = int(starts[j])
        if len(runs):
            for k, s in zip(runs[inside >= 5].tolist(), p[inside >= 5].tolist()):
                number(k, s, 5)
        index_of = {int(s): k for k, s in enumerate(starts.tolist())} if found else {}
        n = len(words)
        for s, e, what, form, tail in sorted(found):
            k = index_of.get(s)
            if k is None:
                continue
            j = k
            while j < n and starts[j] < e:
                j += 1
            d = owner[k]
            line_from, line_to = lines[s], lines[e]
            left: list[str] = []
            right: list[str] = []
            near_left = near_right = "-"
            for i in range(k - 1, max(-1, k - 1 - _NEAR), -1):
                if owner[i] != d or lines[starts[i]] < line_from - 1:
                    break
                if kind[starts[i]] == 1 or not left:
                    left.append(low(i))
                if words[i] in ".!?" and words[i + 1][:1].isupper() and len(words[i - 1]) > 3:
                    break
                if near_left == "-":
                    near_left = "+".join(c for c in _CUES_OF.get(low(i), ()) if c in _OF_CHUNK) or "-"
            for i in range(j, min(n, j + _NEAR)):
                if owner[i] != d or lines[starts[i]] > line_to:
                    break
                if words[i] in ".!?" and right:
                    break
                right.append(low(i))
                if near_right == "-":
                    near_right = "+".join(c for c in _CUES_OF.get(low(i), ()) if c in _OF_CHUNK) or "-"
            outline = _outline(joined[s:e])
            groups = "-".join(str(len(x)) for x in re.findall(r"\d+", joined[s:e]))
            head, last = ("A" if outline[:1] == "A" else outline[:1]), outline[-1:]
            lefts = [w for w in left if w and (w[0].isalpha())][:2]
            about = [f"f{form}", f"cl{near_left}", f"cr{near_right}", f"c{near_left}/{near_right}", f"<{lefts[0] if lefts else ''}", f"<<{' '.join(lefts)}", f"l{left[0] if left else ''}", f">{right[0] if right else ''}"]
            if what == "N":
                digits = sum(c == "9" for c in outline)
                zero = joined[s : s + 2].startswith("0")
                about += [f"|{outline}", f"g{groups}", f"h{head}{last}{digits}", f"z{zero}{digits}", f"|{outline}{near_left}", f"g{groups}{near_left}/{near_right}", f"h{head}{last}{near_left}", f"h{head}{last}{near_left}/{near_right}"]
            elif what == "A":
                about += [f"u{sum(w[:1].isupper() for w in words[k:j] if w[:1].isalpha()) > 0}{form}", f"n{min(j - k, 8)}{form}"]
            at = self.at[k:j].tolist()
            self.inside[what] += at
            if what == "E":
                span = (int(s - base[d]), int(e - base[d]))
                self.hull.update(dict.fromkeys(at, span))
            for i, t in enumerate(at):
                sure = lead.get(s, s)
                where = "P" if starts[k + i] < sure else "T" if starts[k + i] >= tail else "B" if starts[k + i] == sure else "I"
                tag = what + where
                self.extra.append((t, tag))
                self.extra += [(t, f"{tag}{x}") for x in about]
            if j < n and owner[j] == d:
                self.extra.append((int(self.at[j]), "after" + what))
            if k and owner[k - 1] == d:
                self.extra.append((int(self.at[k - 1]), "before" + what))


def _word_features(word: str, names: dict[str, str], known: frozenset[str] | None, words: dict[str, str]) -> tuple[list[str], str]:
    """Features of a word for any offset, and its class for pairs of neighbours."""
    if not word:
        return ["pad"], "pad|pad"
    low, s = word.lower(), shape(word)
    letters = word[0].isalpha()
    listed = names.get(low, "-") if letters else "-"
    common = words.get(low, "n") if letters else "-"
    cues = _CUES_OF.get(low, ())
    kind = f"{s}{listed}{common}{cues[0] if cues else ''}|{s if letters or not low.isdigit() else 'd'}{'L' if listed != '-' else ''}"
    out = [f"s{s}", f"g{listed}", f"x{common}", f"c{s}{listed}{common}", *(f"k{c}" for c in cues), *(f"k{c}{s}" for c in cues)]
    if known is None or low in known:
        out.append(f"w{low}")
    if letters and not cues:
        out.append(f"nk{s}{listed}{common}")
    return out, kind


_DETERMINERS = frozenset("the a an our my your his her their this that der die das ein eine el la los las un una le les une des du unser mein mi su mon ma notre".split())
_RUN = 5


@functools.lru_cache(_CACHE_WORDS)
def _run_class(word: str) -> tuple[bool, bool, str, str]:
    """(capitalised, joins capitalised words, cue at the end of a run of them, class as the word before such a run)."""
    if not word:
        return False, False, "", "pad"
    low, cues = word.lower(), _CUES_OF.get(word.lower(), ())
    if not word[0].isalpha():
        return False, word in "-.&'’", "", word if word in ".,:;!?()-\"“>" else "#"
    if word[0].isupper():
        return True, False, next((c for c in cues if c in ("firm", "town", "street")), ""), "cap"
    return False, low == "s", "", cues[0] if cues else "det" if low in _DETERMINERS else "low"


def _runs(texts: Texts) -> list[tuple[list[str], np.ndarray]]:
    """Features of the capitalised words of a batch: what their run of capitalised words ends with, within a few words, and
    what stands before it; per feature the names and the tokens' numbers among them."""
    info = [_run_class(w) for w in texts.distinct]
    ahead_names, back_names = sorted({x[2] for x in info} | {""}), sorted({x[3] for x in info} | {""})
    a_of, b_of = {x: i for i, x in enumerate(ahead_names)}, {x: i for i, x in enumerate(back_names)}
    at = texts.index
    cap = np.fromiter((x[0] for x in info), bool, len(info))[at]
    goes = cap | np.fromiter((x[1] for x in info), bool, len(info))[at]
    ahead = np.fromiter((a_of[x[2]] for x in info), np.int64, len(info))[at]
    back = np.fromiter((b_of[x[3]] for x in info), np.int64, len(info))[at]
    line = texts.gaps < 2
    none_a, none_b = a_of[""], b_of[""]
    end, before = np.full(len(at), none_a), np.full(len(at), none_b)
    going, coming = cap.copy(), cap.copy()
    for d in range(1, _RUN + 1):
        going &= np.roll(goes & line, -d)
        here = np.roll(ahead, -d)
        end = np.where(going & (end == none_a), here, end)
        open_ = np.roll(goes, d)
        ended = coming & ~(open_ & np.roll(line, d - 1))
        before = np.where(ended & (before == none_b), np.where(np.roll(line, d - 1), np.roll(back, d), b_of.get("pad", none_b)), before)
        coming &= ~ended
    return [(["r" + x for x in ahead_names], end), (["R" + x for x in back_names], before), ([f"rR{x}/{y}" for x in ahead_names for y in back_names], end * len(back_names) + before)]


class Field:
    """Weights of the conditional random field. Outside of a text the label is O."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray, known: frozenset[str], words: dict[str, str]):
        self.features, self.weights, self.moves, self.known, self.words = features, weights, moves, known, words
        self.cache: tuple | None = None
        self.listed: object = None

    def use_list(self, listed: object) -> None:
        """What is kept of words holds for one list of names only."""
        if self.listed is not listed:
            self.listed, self.cache = listed, None

    def _rows(self, texts: Texts, names: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of words in the tables of scores and classes, which are kept from batch to batch up to a bound."""
        if self.cache is None or len(self.cache[0]) > _CACHE_WORDS or len(self.cache[3]) > _CLASSES - 200:
            table = np.zeros((1024, len(_OFFSETS), len(LABELS)), np.float32)
            known_pairs = [np.full(_CLASSES * _CLASSES, -1, np.int32) for _ in _PAIRS]
            self.cache = ({}, table, np.zeros(1024, np.int64), {}, known_pairs, [np.zeros((0, len(LABELS)), np.float32) for _ in _PAIRS])
        of, table, class_of, classes, known_pairs, scored = self.cache
        f, w = self.features, self.weights
        for word in texts.distinct:
            if word in of:
                continue
            k = of[word] = len(of)
            if k == len(table):
                table, class_of = np.concatenate((table, np.zeros_like(table))), np.concatenate((class_of, np.zeros_like(class_of)))
            described, kind = _word_features(word, names, self.known, self.words)
            class_of[k] = classes.setdefault(kind, min(len(classes), _CLASSES - 1))
            for o, offset in enumerate(_OFFSETS):
                ids = [f[x] for x in (f"{offset}{y}" for y in described) if x in f]
                if ids:
                    table[k, o] = w[ids].sum(0)
        self.cache = (of, table, class_of, classes, known_pairs, scored)
        index = np.fromiter(map(of.__getitem__, texts.distinct), np.int64, len(texts.distinct))[texts.index]
        return index, table, class_of[index]

    def scores(self, texts: Texts, names: dict[str, str]) -> np.ndarray:
        """Score of each label at each token, added up from tables of distinct words and of distinct pairs."""
        index, table, of = self._rows(texts, names)
        n, labels = len(index), len(LABELS)
        out = np.zeros((n, labels), np.float32)
        f, w = self.features, self.weights
        for o, offset in enumerate(_OFFSETS):
            out += table[np.roll(index, -offset), o]
        classes, known_pairs, scored = list(self.cache[3]), self.cache[4], self.cache[5]
        for k, pairs_of in enumerate(_PAIRS):
            _, a, b = pairs_of
            pair = np.roll(of, -a) * _CLASSES + np.roll(of, -b)
            fresh = np.unique(pair[known_pairs[k][pair] < 0])
            if len(fresh):
                rows = np.zeros((len(fresh), labels), np.float32)
                for r, p in enumerate(fresh.tolist()):
                    for x in _pair_features(pairs_of, classes[p // _CLASSES], classes[p % _CLASSES]):
                        i = f.get(x)
                        if i is not None:
                            rows[r] += w[i]
                known_pairs[k][fresh] = len(scored[k]) + np.arange(len(fresh))
                scored[k] = np.concatenate((scored[k], rows))
            out += scored[k][known_pairs[k][pair]]
        for o in (0, 1):
            ids = [f.get(f"b{o}{g}", -1) for g in range(4)]
            out += np.stack([w[i] if i >= 0 else np.zeros(labels, np.float32) for i in ids])[np.roll(texts.gaps, -o)]
        for run_names, of_token in _runs(texts):
            ids = [f.get(x, -1) for x in run_names]
            out += np.stack([w[i] if i >= 0 else np.zeros(labels, np.float32) for i in ids])[of_token]
        where = [(t, f[x]) for t, x in texts.extra if x in f]
        if where:
            t, i = np.array(where).T
            np.add.at(out, t, w[i].astype(np.float32))
        out[~allowed_at(texts)] = _NEVER
        return out

    def decode(self, texts: Texts, names: dict[str, str]) -> np.ndarray:
        """The best label of each token. O is certain at a token where it beats every other label by more than any change
        of moves can bring back; what lies between such tokens is decoded on its own."""
        score, moves = self.scores(texts, names), self.moves.astype(np.float32)
        labels = np.zeros(len(score), np.int8)
        open_ = np.flatnonzero(score[:, 0] - score[:, 1:].max(1) <= self._slack(score))
        if not len(open_):
            return labels
        heads = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
        sizes, first = np.diff(np.append(heads, len(open_))), open_[heads]
        # outside of chunks there are names only
        names_only = np.maximum.reduceat(score[open_][:, [k for k in range(len(LABELS)) if k not in _NAME_LABELS]].max(1), heads) < _NEVER / 2
        for some, among in ((names_only, np.array(_NAME_LABELS)), (~names_only, np.arange(len(LABELS)))):
            self._best_paths(score, moves[np.ix_(among, among)], among, first[some], sizes[some], labels)
        return labels

    @staticmethod
    def _best_paths(score: np.ndarray, moves: np.ndarray, among: np.ndarray, first: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        """Writes the best labels of the stretches from first on, which O surrounds; stretches of like length together."""
        order = np.argsort(sizes, kind="stable")
        i, n = 0, len(among)
        while i < len(order):
            j = i
            while j < len(order) and sizes[order[j]] <= max(16, 2 * sizes[order[i]]) and (j == i or (j - i + 1) * sizes[order[j]] <= _ROOM):
                j += 1
            group = order[i:j]
            done, longest = sizes[group], int(sizes[group].max())
            at = np.minimum(first[group][:, None] + np.arange(longest), len(score) - 1)
            e = score[at][:, :, among]
            best, back = e[:, 0] + moves[0], np.zeros((len(group), longest, n), np.int8)
            finals = np.zeros(len(group), np.int64)
            for t in range(longest):
                if t:
                    step, top = np.zeros((len(group), n), np.int8), best[:, :1] + moves[0]
                    for k in range(1, n):
                        total = best[:, k : k + 1] + moves[k]
                        higher = total > top
                        step[higher] = k
                        top = np.maximum(top, total)
                    back[:, t] = step
                    best = top + e[:, t]
                ended = done == t + 1
                if ended.any():
                    finals[ended] = (best[ended] + moves[:, 0]).argmax(1)
            rows, now = np.arange(len(group)), finals
            for t in range(longest - 1, -1, -1):
                inside = t < done
                labels[at[inside, t]] = among[now[inside]]
                if t:
                    now = np.where(inside, back[rows, t, now], now)
            i = j

    def _slack(self, score: np.ndarray) -> np.ndarray:
        """Per token, how far below O any label may lie and still be part of the best path. Instead of label y between p and q
        there may be O; if q goes on with the piece of y, the piece then begins at q, which costs what the beginning is worse
        than the inside there, and what its moves are worse."""
        m, n = self.moves, len(LABELS)
        ok = allowed_moves()
        most = 0.0
        for y in range(1, n):
            into = np.where(ok[:, y], m[:, y] - m[:, 0], -np.inf).max()
            for q in range(n):
                if ok[y, q]:
                    r = q if LABELS[q][0] != "I" else q - 1
                    most = max(most, into + m[y, q] - m[0, r])
        inner = [k for k in range(n) if LABELS[k][0] == "I"]
        further = max([0.0, *(float(np.where(ok[k], m[k] - m[k - 1], -np.inf).max()) for k in inner)])
        worse = np.maximum(0.0, np.stack([np.where(score[:, k] > _NEVER / 2, score[:, k] - np.maximum(score[:, k - 1], -1e6), 0.0) for k in inner]).max(0))
        return most + further + np.roll(worse, -1) + 1e-3


def _pair_features(pairs_of: tuple[str, int, int], a: str, b: str) -> tuple[str, str]:
    """Of two words' classes, and of their case alone."""
    return f"{pairs_of[0]}{a} {b}", f"{pairs_of[0]}|{a.rpartition('|')[2]} {b.rpartition('|')[2]}"


#: Pairs of word classes: name, and the offsets of the two.
_PAIRS = (("p-", -1, 0), ("p+", 0, 1), ("p=", -1, 1), ("p<", -2, -1))
_CLASSES = 1024
_ROOM = 400_000
_NEVER = np.float32(-1e4)
_IN_NAMES = frozenset(".,-'’")
_NAME_LABELS = [k for k, x in enumerate(LABELS) if x == "O" or x.endswith("-name")]
#: The kinds that only a chunk of some type can be.
_WITHIN = {"email": "E", "phone": "N", "id_number": "N", "address": "A"}


def allowed_at(texts: Texts) -> np.ndarray:
    """Which labels a token can have: what is written as an address or a number, a name on one line without digits and no
    part of the others. Outside of the texts there is O only."""
    ok = np.ones((texts.size, len(LABELS)), bool)
    real = np.zeros(texts.size, bool)
    real[texts.at] = True
    ok[~real, 1:] = False
    for kind, chunk in _WITHIN.items():
        outside = np.ones(texts.size, bool)
        outside[texts.inside[chunk]] = False
        for k, label in enumerate(LABELS):
            if label[2:] == kind:
                ok[outside, k] = False
    letters = texts.each(lambda w: w[:1].isalpha(), bool)
    within = letters | texts.each(lambda w: w in _IN_NAMES, bool)
    for part in "EN":
        letters[texts.inside[part]] = within[texts.inside[part]] = False
    ok[~letters, LABELS.index("B-name")] = ok[~within, LABELS.index("I-name")] = False
    ok[texts.gaps >= 2, LABELS.index("I-name")] = False
    return ok


def allowed_moves() -> np.ndarray:
    """A move into the inside of a piece comes from its beginning or its inside only."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, start in enumerate(LABELS):
                ok[i, j] = start[1:] == to[1:]
    return ok


class _Sum:
    """Row r of the output is the sum of the input's rows c over the given pairs (r, c); backward is the transpose."""

    def __init__(self, r: np.ndarray, c: np.ndarray, rows: int, columns: int):
        self.sides = []
        for a, b, n in ((r, c, rows), (c, r, columns)):
            order = np.argsort(a, kind="stable")
            at = np.flatnonzero(np.diff(a[order], prepend=-1))
            self.sides.append((b[order], at, a[order][at], n))

    @staticmethod
    def _apply(side: tuple, x: np.ndarray) -> np.ndarray:
        take, at, to, n = side
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(at):
            out[to] = np.add.reduceat(x[take], at, axis=0)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._apply(self.sides[0], x)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._apply(self.sides[1], x)


def _gold(texts: Texts, rows: list) -> np.ndarray:
    """Labels of the tokens; a token of a piece that begins inside of another token's chunk keeps the piece's label."""
    y = np.zeros(texts.size, np.int64)
    for d, (_, spans) in enumerate(rows):
        span = range(texts.first[d], texts.first[d] + int(texts.sizes[d]))
        for a, b, kind in spans:
            begun = False
            for t in span:
                if a <= texts.start[t] < b:
                    y[t] = LABELS.index(("I-" if begun else "B-") + kind)
                    begun = True
    return y


def known_words(sentences: list[str], least: int = KNOWN_IN) -> frozenset[str]:
    """Words that stand in so many of the sentences, slots left out."""
    seen: dict[str, int] = defaultdict(int)
    for s in sentences:
        for w in {x.lower() for x in _TOKEN.findall(re.sub(r"<[^<>]*>", " ", s)) if x[0].isalpha()}:
            seen[w] += 1
    return frozenset(w for w, n in seen.items() if n >= least)


class _Part:
    """A part of the labelled rows: its texts, labels and features, the latter by number."""

    def __init__(self, rows: list, names: dict[str, str], known: frozenset[str], words: dict[str, str], number: dict[str, int]):
        # long texts first: those that go on at a step are then the first ones
        rows = sorted(rows, key=lambda row: -sum(1 for _ in _TOKEN.finditer(row[0])))
        texts = self.texts = Texts([t for t, _ in rows])
        gold, possible = _gold(texts, rows), allowed_at(texts)
        # a piece that the outer form does not meet cannot be learned as one
        gold[~possible[np.arange(texts.size), gold]] = 0
        inner = np.array([x[0] == "I" for x in LABELS])
        gold[inner[gold] & ~allowed_moves()[np.roll(gold, 1), gold]] -= 1
        described = [_word_features(w, names, known, words) for w in texts.distinct]
        # two steps from weights to scores: features of distinct words by offset, and tokens by word; other features directly
        n = len(texts.distinct)
        pairs = [(k * n + w, number.setdefault(f"{o}{y}", len(number))) for w, (x, _) in enumerate(described) for k, o in enumerate(_OFFSETS) for y in x]
        self.cell, self.of_cell = np.array(pairs).T
        owner, numbers = array("i"), array("i")
        kinds, runs = [described[i][1] for i in texts.index.tolist()], _runs(texts)
        for t in texts.at.tolist():
            own = [number.setdefault(x, len(number)) for p in _PAIRS for x in _pair_features(p, kinds[t + p[1]], kinds[t + p[2]])]
            own += [number.setdefault(f"b{o}{texts.gaps[t + o]}", len(number)) for o in (0, 1)]
            own += [number.setdefault(x[of_token[t]], len(number)) for x, of_token in runs]
            owner.extend([t] * len(own))
            numbers.extend(own)
        for t, x in texts.extra:
            owner.append(t)
            numbers.append(number.setdefault(x, len(number)))
        self.owner, self.direct = np.frombuffer(owner, np.int32), np.frombuffer(numbers, np.int32)
        self.uses = np.concatenate([np.bincount(texts.index[texts.at + o], minlength=n) for o in _OFFSETS])
        longest = self.longest = int(texts.sizes.max())
        self.at = np.minimum(texts.first[:, None] + np.arange(longest), texts.size - 1)
        self.alive = np.arange(longest) < texts.sizes[:, None]
        self.mask = possible[self.at].astype(np.float32)
        y = self.y = np.where(self.alive, gold[self.at], 0)
        self.going = [int((texts.sizes > t).sum()) for t in range(longest)]
        self.final, self.some = np.maximum(texts.sizes - 1, 0), texts.sizes > 0
        labels = len(LABELS)
        self.truth = np.zeros((labels, labels))
        both = self.alive[:, 1:]
        np.add.at(self.truth, (y[:, :-1][both], y[:, 1:][both]), 1)
        void = np.zeros(int(self.some.sum()), int)
        np.add.at(self.truth, (void, y[self.some, 0]), 1)
        np.add.at(self.truth, (y[self.some, self.final[self.some]], void), 1)

    def count(self, size: int) -> np.ndarray:
        return np.bincount(self.direct, minlength=size) + np.bincount(self.of_cell, weights=self.uses[self.cell], minlength=size)

    def link(self, keep: np.ndarray, renumber: np.ndarray, features: int) -> None:
        """Sums over the features that are kept, by their new numbers."""
        texts, n = self.texts, len(self.texts.distinct)
        some = keep[self.of_cell]
        self.word_sum = _Sum(self.cell[some], renumber[self.of_cell[some]], n * len(_OFFSETS), features)
        some = keep[self.direct]
        self.token_sum = _Sum(self.owner[some], renumber[self.direct[some]], texts.size, features)
        places = texts.at
        self.by_word = _Sum(np.tile(places, len(_OFFSETS)), np.concatenate([k * n + texts.index[places + o] for k, o in enumerate(_OFFSETS)]), texts.size, n * len(_OFFSETS))

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood, by forward-backward: seen less expected features and moves."""
        n, labels = len(self.y), len(LABELS)
        score = self.by_word.forward(self.word_sum.forward(weights)) + self.token_sum.forward(weights)
        e = score[self.at]
        e = np.exp(e - e.max(2, keepdims=True)) * self.mask + 1e-12
        a = (np.exp(moves) * allowed_moves()).astype(np.float32)
        forward = np.zeros((self.longest, n, labels), np.float32)
        f = e[:, 0] * a[0]
        for t in range(self.longest):
            k = self.going[t]
            f = (f[:k] @ a) * e[:k, t] if t else f
            f = f / f.sum(1, keepdims=True)
            forward[t, :k] = f
        backward = np.tile(a[:, 0], (n, 1))
        marginal = np.zeros((n, self.longest, labels), np.float32)
        expected = np.zeros((labels, labels))
        for t in range(self.longest - 1, -1, -1):
            k = self.going[t]
            p = forward[t, :k] * backward[:k]
            marginal[:k, t] = p / p.sum(1, keepdims=True)
            if t:
                right = e[:k, t] * backward[:k]
                z = ((forward[t - 1, :k] @ a) * right).sum(1)
                expected += a * ((forward[t - 1, :k] / z[:, None]).T @ right)
                back = right @ a.T
                backward[:k] = back / back.sum(1, keepdims=True)
        expected[0] += marginal[self.some, 0].sum(0)
        expected[:, 0] += marginal[self.some, self.final[self.some]].sum(0)
        grad = np.zeros((self.texts.size, labels), np.float32)
        grad[self.at[self.alive]] = np.eye(labels, dtype=np.float32)[self.y[self.alive]] - marginal[self.alive]
        return self.word_sum.backward(self.by_word.backward(grad)) + self.token_sum.backward(grad), self.truth - expected


def fit(rows: list, names: dict[str, str], known: frozenset[str], words: dict[str, str], rounds: int = ROUNDS, least: int = 4, decay: float = 0.5, seed: int = 3) -> Field:
    """The field of high penalised likelihood on labelled rows: so many rounds of gradient steps over parts of them."""
    number: dict[str, int] = {}
    parts = [_Part(rows[i : i + _PART_ROWS], names, known, words, number) for i in range(0, len(rows), _PART_ROWS)]
    often = sum(p.count(len(number)) for p in parts)
    keep, renumber = often >= least, np.cumsum(often >= least) - 1
    features = {x: int(renumber[i]) for x, i in number.items() if keep[i]}
    for p in parts:
        p.link(keep, renumber, len(features))
    labels = len(LABELS)
    weights, moves = np.zeros((len(features), labels), np.float32), np.zeros((labels, labels))
    m, v = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    rng, step, steps, share = np.random.default_rng(seed), 0, rounds * len(parts), 1 / len(parts)
    for _ in range(rounds):
        for k in rng.permutation(len(parts)).tolist():
            step += 1
            g, moved = parts[k].gradient(weights, moves)
            rate = 0.08 * (1 - step / steps) + 0.004
            for x, grad, mean, square in zip((weights, moves), (g - decay * share * weights, moved - 0.1 * share * moves), m, v):
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad**2 - square)
                x += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-3)
    return Field(features, weights, np.where(allowed_moves(), moves, _NEVER), known, words)


_trained: dict[str, Field] = {}


def train(spark: SparkSession | None = None, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, seed: int = 20, words: tuple[str, ...] = LEXICON) -> Field:
    """The field trained on so many rows of the labelled table; the bound is the parameter, whatever the data. With a session
    its weights are kept in the shared folder, under a name made of all they depend on, and read from there the next time."""
    of = inspect.getsource(pii_table) + inspect.getsource(inspect.getmodule(fit)) + repr((rows, rounds, seed, words))
    key = hashlib.md5(of.encode()).hexdigest()
    if key in _trained:
        return _trained[key]
    path, stored = (f"{shared_folder(spark)}/field-{key}" if spark else None), None
    if path:
        try:
            # as many rows as the training table yields features
            stored = spark.read.schema("part string, key string, value array<float>").parquet(path).collect()
        except AnalysisException:
            stored = None
    table = pii_table.sentences
    known = known_words(table(pii_table.CARRIERS) + table(pii_table.NAMES) + table(pii_table.OTHERS))
    if stored:
        of_part = {p: [(r.key, r.value) for r in stored if r.part == p] for p in ("feature", "move")}
        features = {k: i for i, (k, _) in enumerate(of_part["feature"])}
        moves = np.array([x for _, x in sorted((int(k), x) for k, x in of_part["move"])])
        field = Field(features, np.array([x for _, x in of_part["feature"]], np.float32), moves, known, lexicon(words))
    else:
        labelled, names = labelled_rows(rows, seed)
        field = fit(labelled, names, known, lexicon(words), rounds)
        if path:
            kept = [("feature", k, field.weights[i].tolist()) for k, i in field.features.items()] + [("move", str(i), [float(x) for x in row]) for i, row in enumerate(field.moves)]
            spark.createDataFrame(kept, "part string, key string, value array<float>").coalesce(1).write.mode("overwrite").parquet(path)
    _trained[key] = field
    return field


def pieces(field: Field, names: dict[str, str], texts: list[str], listed: object = None) -> list[list[tuple[int, int, str]]]:
    """Per text: (start, end, kind) of each piece of personal information, in order. names holds at least the texts' words
    that are on the list of names; where it is only a part of one, `listed` stands for the whole list."""
    field.use_list(names if listed is None else listed)
    batch = Texts(texts)
    labels = field.decode(batch, names)
    out: list[list] = [[] for _ in texts]
    marked = np.flatnonzero(labels)
    owner = np.searchsorted(batch.first, marked, side="right") - 1
    for t, d in zip(marked.tolist(), owner.tolist()):
        prefix, kind = LABELS[labels[t]].split("-", 1)
        found = out[d]
        if kind == "email":
            # an e-mail address is the whole chunk, or none of it
            if not found or found[-1][:2] != list(batch.hull[t]):
                found.append([*batch.hull[t], kind])
        elif prefix == "B" or not found or found[-1][2] != kind:
            found.append([int(batch.start[t]), int(batch.end[t]), kind])
        else:
            found[-1][1] = int(batch.end[t])
    return [[tuple(x) for x in found] for found in out]


def _name_table(names: DataFrame) -> DataFrame:
    """(n, p): names in lower case with G for given or F for family; a name that is both is a given one."""
    part = F.when(F.col("name_part") == "given", "G").otherwise("F")
    return names.where("name is not null").select(F.lower("name").alias("n"), part.alias("p")).groupBy("n").agg(F.max("p").alias("p"))


def _with_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows (d, t) with a map l of the text's words that are listed names, by joins: for lists of any length. Every distinct
    text is looked at once; a text that many rows repeat is spread over tasks."""
    keyed = materialise(rows.withColumn("k", F.struct(F.xxhash64("t"), F.xxhash64("t", F.lit(5))).cast("string")), "texts")
    texts = keyed.where("t is not null").groupBy("k").agg(F.any_value("t").alias("t"))
    words = texts.select("k", F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))).alias("n")).where("n <> ''")
    named = words.join(listed, "n").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("n", "p"))).alias("l"))
    return skew_join(keyed.where("k is not null"), named, plan_load(keyed, ["k"]), ["d"], "left").select("d", "t", "l")


def _run(docs: DataFrame, doc: str, text: str, names: DataFrame, schema: str, emit) -> DataFrame:
    spark = docs.sparkSession
    listed = _name_table(names)
    few = listed.limit(MOST_NAMES + 1).collect()
    rows = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"))
    joined = len(few) > MOST_NAMES
    rows = _with_listed(rows, listed) if joined else rows
    sent = spark.sparkContext.broadcast((train(spark), {} if joined else {r.n: r.p for r in few}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, all_names = sent.value
        for batch in batches:
            for i in range(0, len(batch), _BATCH):
                part = batch.iloc[i : i + _BATCH]
                texts = [t or "" for t in part["t"].tolist()]
                own = {n: p for l in part["l"] if l is not None for n, p in (l.items() if isinstance(l, dict) else l)} if joined else all_names
                yield emit(part, texts, pieces(field, own, texts, all_names))

    return rows.mapInPandas(run, schema)


def find_pii(docs: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, kind, surface, start, end): one row for each piece of personal information, as it stands in the text.

    A null or empty text has none. Positions count characters. Texts are read whole; repeated rows are kept."""
    kind = docs.schema[doc].dataType.simpleString()

    def emit(part, texts, found):
        ids = part["d"].tolist()
        rows = [(ids[k], kind, texts[k][a:b], a, b) for k, x in enumerate(found) for a, b, kind in x]
        return pd.DataFrame(rows, columns=["doc", "kind", "surface", "start", "end"])

    return _run(docs, doc, text, names, f"doc {kind}, kind string, surface string, start bigint, end bigint", emit)


def mask_pii(docs: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, text, n_masked): every text with its personal information replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS]
    or [NAME], and otherwise unchanged; a null text stays null."""
    kind = docs.schema[doc].dataType.simpleString()

    def emit(part, texts, found):
        out = []
        for t, old, x in zip(texts, part["t"].tolist(), found):
            done, at = [], 0
            for a, b, k in x:
                done += [t[at:a], f"[{k.upper()}]"]
                at = b
            out.append(None if old is None else "".join(done) + t[at:])
        return pd.DataFrame({"doc": part["d"].tolist(), "text": out, "n_masked": [len(x) for x in found]})

    return _run(docs, doc, text, names, f"doc {kind}, text string, n_masked bigint", emit)
