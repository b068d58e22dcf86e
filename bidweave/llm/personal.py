"""Personal information in free text, found behind disguises and replaced by typed placeholders.

Each text passes through offset-preserving transducers that undo disguises: look-alike and full-width letters, invisible
characters, spelled digits, "at" and "dot" in words or brackets, addresses broken over lines. Identifiers are detected in
the normalised text and their spans are mapped back to the source, whose other characters stay as they are.

Kinds: ``email``, ``phone``, ``idnum``, ``address``, ``name``. Names are found by the lexicon, by surnames composed of the same
parts as the lexicon's (it is incomplete), by what stands beside them (a title, a usual given name, an initial) and by a small
classifier of runs of capitalised words. It is trained on all runs of all texts, where the lexicon's rules give the labels, from
shape, neighbours and whether the words are also written small; it sees no lexicon. Its threshold is the least score from which on
all but one in a hundred of the runs are labelled names. Texts with fewer than ``LEAST_NAMES`` such names in all train none.
Defined results: a null text has no items and stays null, an empty one stays empty; ``start_pos`` counts Unicode characters
from 1; of overlapping items the one that starts first, then the longest, holds; rows are never dropped or repeated.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.session import spread, table, write_out

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
INVISIBLE = "​‌‍⁠﻿\xad"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TLDS = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|us|ca|uk|es|fr|de|mx|example|test|invalid)"

#: Given names usual in many countries, none of them a common word.
GIVEN = """
Aaron Abdul Adam Adrian Agnes Ahmed Alan Albert Alejandro Alexander Alexandra Ali Alice Alicia Amanda Amy Ana Andrea Andrew Andrzej Angela Anita Anna Anne Anthony Antonio
Arjun Barbara Beatriz Benjamin Boris Brandon Brenda Brian Bruno Carla Carlos Carmen Carol Caroline Catherine Charles Chen Christina Christopher Claire Claudia Cynthia Daniel
David Deborah Denise Dennis Diana Diego Dmitri Donald Donna Dorothy Douglas Edward Elena Elizabeth Emily Emma Enrique Eric Esther Eugene Fatima Felix Fernando Francisco Gabriel
Gary George Gerald Giovanni Gloria Gregory Hans Hannah Hassan Heather Helen Henry Hiroshi Hussein Ibrahim Igor Ines Isabel Ivan Jacob James Jane Janet Jason Javier Jennifer
Jessica Joan Johanna John Jonathan Jorge Jose Joseph Joshua Juan Julia Karen Katarzyna Keith Kenneth Kevin Kumar Larry Laura Lars Linda Lisa Lucia Luis Lukasz Margaret Maria Marie
Mario Martin Mary Matthew Mei Michael Michelle Miguel Mohammed Monica Muhammad Nancy Natalia Nicholas Olga Oliver Omar Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Ramon
Rebecca Ricardo Richard Robert Roberto Sandra Sarah Sergei Sofia Stephen Susan Svetlana Teresa Thomas Timothy Wei William Yusuf
""".split()

_D = "|".join(DIGIT_WORDS)
_DIGIT = rf"(?:(?:(?:double|triple)[\s-]+)?(?:{_D})\b|\d+)"
#: A stretch of digits of which some are spelled, and numbers in which letters stand for digits.
_SPELLED = re.compile(rf"(?<![\w.]){_DIGIT}(?:[\s,.-]{{1,3}}{_DIGIT}){{2,}}(?!\w)", re.I)
_LETTERED = re.compile(r"(?<![\w-])[(]?[2-9](?=(?:[^\n]{0,2}\d){2})[\dOoIl]{2}[)]?[-. ]?[2-9OoIl][\dOoIl]{2}[-. ][\dOoIl]{4}(?![\w-])")
#: Without this a number has no letter that stands for a digit: the first such letter follows a digit.
_LETTER = re.compile(r"\d[)]?[-. ]?[OoIl](?:[\dOoIl]|(?![\w-]))")
#: Words of which a spelled number has some; the others stand in many words.
_TELLING = ("zero", "three", "four", "five", "six", "seven", "eight", "nine")
_TO_DIGITS = str.maketrans("OoIl", "0011")
_AT = re.compile(r"(?<=[\w])[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*(?=\w)", re.I)
_DOT = re.compile(r"(?<=[\w])[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*(?=\w)", re.I)
_LOCAL = r"(?<![\w.+-])[\w.+'-]+(?:[ \t]+(?:dot|underscore|dash)[ \t]+[\w+'-]+){0,9}"
_WORDS = re.compile(rf"{_LOCAL}[ \t]+at[ \t]+(?:[\w-]+[ \t]+dot[ \t]+)+[A-Za-z]{{2,10}}\b", re.I)
_SPACED = re.compile(rf"(?<![\w.+-])[\w.+'-]+[ \t]?@[ \t]?[\w-]+(?:(?:\.|[ \t]\.[ \t])[\w-]+)*(?:\.|[ \t]\.[ \t]){TLDS}\b", re.I)
_MIXED = re.compile(rf"{_LOCAL}(?:[ \t]+at[ \t]+|@)[\w-]+(?:(?:\.|[ \t]+dot[ \t]+)[\w-]+)*[ \t]+dot[ \t]+{TLDS}\b", re.I)
_BREAK_AT = re.compile(r"(?<=[\w])[ \t]*\n[ \t]*(?=@[\w-]+\.)|(?<=\w@)[ \t]*\n[ \t]*(?=[\w-]+\.\w)")
_BREAK = re.compile(r"\n[ \t]*@|@[ \t]*\n")
_BREAK_DOT = re.compile(rf"(@[\w-]+(?:\.[\w-]+)*\.)[ \t]*\n[ \t]*(?={TLDS}\b)", re.I)
_BREAK_DOT2 = re.compile(rf"(@[\w-]+(?:\.[\w-]+)*)[ \t]*\n[ \t]*(?=\.{TLDS}\b)", re.I)

_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%'-]*@[A-Za-z0-9](?:[\w-]*\w)?(?:\.[A-Za-z0-9](?:[\w-]*\w)?)+")
_PHONES = [
    re.compile(r"(?<![\w.+/-])(?<!\d )(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ ./-])[2-9]\d{2}[ .-]\s?\d{4}(?![\w-]|\.\d)(?:[,\s]{0,2}(?:ext\.?|x|extension)\s?\d{1,6})?"),
    re.compile(r"(?<![\w.+/-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w.+/-])(?:\(0\d{2,4}\)|0\d{2,4})[ -]\d{3,4}[ -]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,5})){2,6}(?![\w-])"),
]
_NOT_PHONE = re.compile(r"(?:order|account|code|invoice|item|contract|solicitation|firmware|model|unit|part|reference|sku|no)\W{0,3}$", re.I)
_IDS = [
    (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), False),
    (re.compile(r"(?<![\w-])\d{2}-\d{7}(?![\w-])"), False),
    (re.compile(r"(?<![\w-])[A-Z]\d{4}-\d{4}-\d{4}(?![\w-])"), False),
    (re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"), False),
    (re.compile(r"(?<![\w-])\d{3}[ .]\d{2}[ .]\d{4}(?![\w-])"), True),
    (re.compile(r"(?<![\w-])[A-Z]\d{7,8}(?![\w-])"), True),
    (re.compile(r"(?<![\w-])\d{9}(?![\w-])"), True),
    (re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])"), True),
]
#: Without a match of it there is no identity number and no phone number.
_NUMBER = re.compile("|".join(f"(?:{p.pattern})" for p in [*_PHONES, *(p for p, _ in _IDS)]))
_CAPTION = re.compile(r"(?:ss[n#]|social security|tax|tin\b|ein\b|itin|licen[cs]e|passport|pasaporte|identi|\bid\b|national insurance|dl ?#|\bdni\b|\bnif\b|\bnie\b|affiant|s[ée]curit[ée] sociale|permis)[^\n.;]{0,28}(?:no\.|n\.º|number)?[\s:#.]*$", re.I)
_DIRECTION = r"(?:(?:[NSEW]|NE|NW|SE|SW)\.?\s+|(?:North|South|East|West|NORTH|SOUTH|EAST|WEST)\s+)?"
_SUFFIX = r"(?:Street|Avenue|Boulevard|Road|Lane|Drive|Court|Terrace|Parkway|Place|Circle|Highway|Square|Trail|Way|Loop|Alley|Crescent|Blvd|Pkwy|Ave|Cres|Ter|Hwy|Cir|Sq|Trl|St|Rd|Ln|Dr|Ct|Pl)"
_ADDRESSES = [
    re.compile(
        rf"(?=\d)(?<![\w$#.,/-])\d{{1,6}}(?:-?[A-Z])?\s+{_DIRECTION}(?:(?:[A-Z][\w'’-]+|\d{{1,3}}(?:st|nd|rd|th))\s+){{1,3}}?(?:{_SUFFIX}|{_SUFFIX.upper()})\b\.?"
        r"(?:,?[ \t]*(?:Apt|APT|Suite|SUITE|Ste|Unit|UNIT|Floor|FLOOR|Room|ROOM|#)\.?[ \t]?#?[ \t]?[\w-]+)?(?:(?:,[ \t]*|[ \t]*\n[ \t]*)[A-Z][\w'’-]+(?:[ \t][A-Z][\w'’-]+)?(?:,[ \t]*[A-Z]{2}\b(?:[ \t]+\d{5}(?:-\d{4})?)?|(?=[.;\n]|$)))?"
    ),
    re.compile(r"\b(?:P\.?[ \t]?O\.?[ \t]*|Post[ \t]+Office[ \t]+|PO[ \t]+)(?:Box|BOX)[ \t]+#?\d+(?:(?:,[ \t]*|[ \t]*\n[ \t]*)[A-Z][\w'’-]+(?:,[ \t]*[A-Z]{2}\b(?:[ \t]+\d{5})?|(?=[.;\n]|$)))?", re.I),
    re.compile(r"\b(?:Apartado(?:\s+(?:de\s+correos|postal))?|Casilla(?:\s+postal)?|Bo[îi]te\s+postale|B\.?P\.)\s+\d+", re.I),
    re.compile(r"\b(?:Calle|Avenida|Av\.|Avda\.|Paseo|Plaza|Camino|Carrera|Carretera|Ronda|C/|CALLE|AVENIDA)\s*(?:(?:de|del|la|las|los)\s+)*[A-ZÁÉÍÓÚÑ][\w'’-]+(?:\s+[A-ZÁÉÍÓÚÑ][\w'’-]+)?,?\s+(?:n\.?[º°o]\.?\s*|n[úu]m\.?\s*|#)?\d{1,5}\b(?:,\s*piso\s+\d+\w?)?"),
    re.compile(r"(?=\d)(?<![\w$#.,-])\d{1,5}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)\s+(?:(?:de|du|des|la|le|les|l'|d')\s*)*[A-ZÉÈÀ][\w'’-]+"),
]
#: Without one of these a text has no address of the form; any text may have the first.
_ADDRESS_HINTS = [
    ("",),
    ("box ", "box\t"),
    ("apartado", "casilla", "postale", "bp.", "b.p."),
    ("calle", "avenida", "av.", "avda", "paseo", "plaza", "camino", "carrera", "carretera", "ronda", "c/"),
    (" rue ", " avenue ", " boulevard ", " place ", " chemin ", " allée ", " impasse ", " quai ", " route ", " cours "),
]
#: A stretch that can hold a phone or identity number: five digits at least.
_NUMERIC = re.compile(r"\d(?:[\s().\-/+]{0,3}\d){4,}[A-Z]?")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Hon|Sr|Sra|M|Mme|MR|MRS|MS|DR)\.?"
#: Words in capitals that stand before or after a surname without being a part of the name.
_NOT_GIVEN = {"dear", "attn", "attention", "contact", "buyer", "signed", "present", "mr", "mrs", "ms", "miss", "dr", "prof", "hon", "the", "on", "at", "by", "and", "officer", "from", "to", "for", "with", "present", "phone", "tel", "office", "sr", "jr", "sra", "no", "write", "mail", "deliver", "call", "see", "ask", "north", "south", "east", "west", "firmado", "por", "con", "comuníquese", "senior", "chief", "head", "director", "manager", "clerk", "agent", "buyer:", "item", "section", "page", "project", "in", "of", "per", "as", "both", "all", "any", "each", "every", "where"}
_AFTER_FIRM = re.compile(r"\s*(?:&|,?\s*(?:Ltd|LTD|Inc|INC|LLC|LLP|Co\.|Corp|GmbH|S\.A\.|plc|PLC|and\s+Sons|Bros|Partners|Associates|Group|Company|Holdings|Industries|Foundation)\b)|\s+(?:Street|Avenue|Road|Bridge|Lane|Drive|Court|Park|County|City|School|Library|Hall|Center|Centre|Building|Plaza|Station|Project|Field|Bay|Creek|River|Lake|Hill|University|College|Hospital|Memorial|Elementary|Wing|Tower|House|Annex|Auditorium|District|Authority|Board|Pavilion|Campus|Depot)\b", re.I)
_PLACE = re.compile(r"\b(?:Street|Avenue|Road|Bridge|Lane|Drive|Court|Park|County|City|School|Library|Hall|Center|Centre|Building|Plaza|Station|Project|University|College|Hospital|Memorial|Elementary|District|Authority|Board|Ltd|Inc|LLC|LLP|Corp|Company|Group|Foundation)\b", re.I)
_BEFORE_FIRM = re.compile(r"(?:&\s*|\b(?:Bridge|Project|Firm|Company)\s+)$")


class Text:
    """A text under transformation; ``at[i]`` is the source position of its character i."""

    def __init__(self, source: str):
        self.s, self.starts, self.shifts = source, [0], [0]
        self.size = len(source)

    def back(self, i: int) -> int:
        """Source position of character i; ``shifts`` holds, from each start on, how far the source is ahead."""
        k = bisect_right(self.starts, i) - 1
        return i + self.shifts[k]

    def sub(self, pattern: re.Pattern, put) -> None:
        """Replace matches by ``put(match)``; the characters of a replacement map to the match's start."""
        hits = list(pattern.finditer(self.s))
        if not hits:
            return
        parts, pieces, last, size = [], [], 0, 0
        for m in hits:
            if m.start() > last:
                pieces.append((size, last, m.start()))
                parts.append(self.s[last : m.start()])
                size += m.start() - last
            new = put(m)
            for j in range(len(new)):
                # The last character maps to the match's last one, so that spans end where the disguise ends.
                last_one = j == len(new) - 1 > 0
                pieces.append((size + j, m.end() - 1 if last_one else m.start() + min(j, m.end() - m.start() - 1), None))
            parts.append(new)
            size += len(new)
            last = m.end()
        if last < len(self.s):
            pieces.append((size, last, len(self.s)))
        parts.append(self.s[last:])
        starts, shifts = [], []
        for at, old, stop in pieces:
            starts.append(at)
            shifts.append(self.back(old) - at)
            if stop is not None:  # segment borders of the earlier map that lie inside
                k = bisect_right(self.starts, old)
                while k < len(self.starts) and self.starts[k] < stop:
                    starts.append(at + self.starts[k] - old)
                    shifts.append(self.starts[k] + self.shifts[k] - (at + self.starts[k] - old))
                    k += 1
        self.s, self.starts, self.shifts = "".join(parts), starts or [0], shifts or [0]


_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_STRANGE = re.compile(f"[{INVISIBLE}{''.join(LOOKALIKES)}！-～‐-―−\u00a0\u2007\u202f\U0001d400-\U0001d7ff]")
_ODD = re.compile(f"[{''.join(LOOKALIKES)}]|[！-～‐-―−   \U0001d400-\U0001d7ff]")


def _plain(m: re.Match) -> str:
    ch = m[0]
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch in "‐‑‒–—―−":
        return "-"
    if ch in "   ":
        return " "
    n = unicodedata.normalize("NFKC", ch)
    return n if len(n) == 1 else ch


def _mixed_script(s: str) -> bool:
    return bool(re.search(f"[A-Za-z0-9@.][{''.join(LOOKALIKES)}]|[{''.join(LOOKALIKES)}][A-Za-z0-9@.]", s))


_SAID = {"at": "@", "dot": ".", "underscore": "_", "dash": "-"}


def _undo_words(m: re.Match) -> str:
    return re.sub(r"[ \t]+(at|dot|underscore|dash)[ \t]+", lambda w: _SAID[w[1].lower()], m[0], flags=re.I)


def _undo_digits(m: re.Match) -> str:
    """The digits of a stretch, if some are spelled and they can be a number; else the stretch as it is."""
    out, words, times = [], 0, 1
    for w in re.findall(rf"double|triple|{_D}|\d+", m[0].lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            words += w in DIGIT_WORDS and w != "oh"  # also a state
            out.append(DIGIT_WORDS.get(w, w) * times)
            times = 1
    digits = "".join(out)
    return digits if words > 1 and 7 <= len(digits) <= 15 else m[0]


_BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|@|dot|\.)[ \t]*[\])}>]")


def normalised(source: str) -> Text:
    t = Text(source)
    if not source.isascii() and _STRANGE.search(source):
        t.sub(_INVISIBLE, lambda m: "")
        if _mixed_script(t.s):
            t.sub(_ODD, _plain)
        else:
            t.sub(re.compile("[！-～‐-―−   ]"), _plain)
    low = t.s.lower()
    if _BRACKETED.search(low):
        t.sub(_AT, lambda m: "@")
        t.sub(_DOT, lambda m: ".")
    if "dot " in low or "dot\t" in low:
        t.sub(_WORDS, _undo_words)
        t.sub(_MIXED, _undo_words)
    if "@" in t.s:
        if any(x in t.s for x in (" @", "@ ", "\t@", "@\t", " . ")):
            t.sub(_SPACED, lambda m: re.sub(r"[ \t]", "", m[0]))
        if _BREAK.search(t.s):
            t.sub(_BREAK_AT, lambda m: "")
        t.sub(_BREAK_DOT, lambda m: m[1])
        t.sub(_BREAK_DOT2, lambda m: m[1])
    if sum(map(low.count, _TELLING)) > 1 and _SPELLED.search(t.s):
        t.sub(_SPELLED, _undo_digits)
    if _LETTER.search(t.s):
        t.sub(_LETTERED, lambda m: m[0].translate(_TO_DIGITS))
    return t


_UPPER = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isupper())
_CAP = rf"[{_UPPER}][^\W\d_]+"
#: Titles that stand before names, with and without a full stop.
TITLES, DOTTED_TITLES = {"Mr", "Mrs", "Ms", "Miss", "Mx", "MR", "MRS", "MS"}, {"Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Sra", "Mme", "MR", "MRS", "MS", "DR"}
_INITIAL_GAP = re.compile(r"[ \t]+[A-Z]\.[ \t]*")
#: What may stand between two capitalised words of a name, or a title and a name; a full stop only after a title.
_LINK = re.compile(r"[^\S\n]+(?:[A-Z]\.[ \t]*)?|\.[ \t]*")
#: The least number of labelled names that train a classifier, the share of them among the runs that it takes for names, and its least score in tenths.
LEAST_NAMES, SURE, LEAST_SCORE = 200, 0.99, 20
#: A word is common if it is written small at least once for this many times that it stands with a capital beside another such word.
COMMON = 100
_WORD_BEFORE = re.compile(r"([\w'’]*)([^\w\n]*)$")
_WORD_AFTER = re.compile(r"([^\w\n]*)([\w'’]*)")
_SMALL = re.compile(r"(?<![\w.@-])[a-z]{2,}(?![\w@])")


class Words:
    """Counts of words written small and of capitalised words beside others."""

    def __init__(self):
        self.pieces: Counter[str] = Counter()
        self.capital: Counter[str] = Counter()

    def add(self, s: str, beside: list[re.Match]) -> None:
        self.pieces.update(s.split())
        self.capital.update([m[0] for m in beside])

    def rows(self) -> list[dict]:
        small: Counter[str] = Counter()
        capital: Counter[str] = Counter()
        for word, n in self.capital.items():
            capital[word.lower()] += n
        for piece, n in self.pieces.items():  # neither a word written small nor an address goes over white space
            for w in _SMALL.findall(_EMAIL.sub(" ", piece) if "@" in piece else piece):
                small[w] += n
        return [{"word": w, "small": small[w], "capital": capital[w]} for w in small.keys() | capital.keys()]


def _class(word: str) -> str:
    """A neighbour as a feature; all numbers are one."""
    return "0" if word[:1].isdigit() else word.lower()


class Model:
    """A logistic classifier of runs of capitalised words whose weights come from counts over all texts."""

    def __init__(self, common: frozenset[str], weights: dict[str, float] | None = None, least: float = math.inf):
        self.common, self.weights, self.least = common, weights or {}, least

    def features(self, s: str, run: list[re.Match]) -> list[str]:
        """Shape and neighbours of a run of capitalised words; none if one of them is a common word."""
        words = [m[0] for m in run]
        if not 2 <= len(words) <= 3 or not self.common.isdisjoint([w.lower() for w in words]):
            return []
        start, end = run[0].start(), run[-1].end()
        before = _WORD_BEFORE.search(s[max(0, start - 24) : start])
        after = _WORD_AFTER.match(s[end : end + 24])
        shape = "".join("A" if w.isupper() else "a" for w in words)
        return ["", f"shape {shape} {'.' in s[start:end]}", f"before {_class(before[1])} {before[2].strip()[-1:]}", f"after {after[1].strip()[:1]} {_class(after[2])}"]

    def score(self, features: Iterable[str]) -> int:
        """In tenths."""
        return math.floor(10 * sum(self.weights.get(x, 0.0) for x in features))

    def weigh(self, counts: dict[str, tuple[int, int]]) -> bool:
        """Weights from the numbers of names and of other runs that have a feature, each with one run more that is divided as all are; false if there are too few names."""
        names, others = counts.get("", (0, 0))
        if names < LEAST_NAMES:
            return False
        share = (names + 1) / (names + others + 2)
        usual = math.log(share / (1 - share))
        self.weights = {f: math.log((y + share) / (n + 1 - share)) - usual for f, (y, n) in counts.items()}
        self.weights[""] = usual
        return True

    def limit(self, scores: dict[int, tuple[int, int]]) -> None:
        """Threshold from the numbers of names and of other runs that have a score."""
        names = others = 0
        for x in sorted(scores, reverse=True):
            names, others = names + scores[x][0], others + scores[x][1]
            if x >= LEAST_SCORE and names >= SURE * (names + others):
                self.least = x

    @classmethod
    def fit(cls, texts: list[str], names: Names) -> Model | None:
        """The classifier of a list of texts; ``trained`` gives that of a DataFrame."""
        looks = [look(t, names) for t in texts]
        words = Words()
        for t, _, beside in looks:
            words.add(t.s, beside)
        model = cls(frozenset(r["word"] for r in words.rows() if r["capital"] and r["small"] * COMMON >= r["capital"]))
        cases = [c for t, found, beside in looks for c in suspects(t.s, found, beside, names, model)[1]]
        tally = lambda pairs: {k: (n[True], n[False]) for k, n in pairs.items()}
        counts, scores = defaultdict(Counter), defaultdict(Counter)
        for f, y in cases:
            for x in f:
                counts[x][y] += 1
        if not model.weigh(tally(counts)):
            return None
        for f, y in cases:
            scores[model.score(f)][y] += 1
        model.limit(tally(scores))
        return model


class Names:
    """Recognises names from a lexicon of given names and surnames."""

    def __init__(self, given: list[str], surnames: list[str]):
        self.memo: dict[str, bool] = {}
        self.given = {g.lower() for g in given}
        self.surnames = {s.lower() for s in surnames}
        heads, tails = defaultdict(set), defaultdict(set)
        for s in self.surnames:
            for k in range(3, len(s) - 1):
                heads[s[:k]].add(s[k:])
                tails[s[k:]].add(s[:k])
        # Heads and tails that combine freely make the surnames the lexicon lacks.
        good_tails = {t for t, h in tails.items() if len(t) >= 2 and len({x for x in h if len(heads[x]) >= 4}) >= 3}
        self.heads = {h for h, t in heads.items() if len(t & good_tails) >= 4}
        self.tails = good_tails
        self.usual = self.given | {g.lower() for g in GIVEN}
        self.token = re.compile(rf"[{_UPPER}](?<![\w@.'’+-].)(?:(?<=O)['’][{_UPPER}])?[^\W\d_]+(?:-(?:O['’])?{_CAP})?(?![\w@])")
        self.model: Model | None = None

    def at(self, s: str, starts: Iterable[int]) -> list[re.Match]:
        """The capitalised words that begin at ``starts``."""
        return [self.token.match(s, a) for a in starts]

    def is_surname(self, token: str) -> bool:
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            known = self.memo[token] = self._is_surname(token)
        return known

    def _is_surname(self, token: str) -> bool:
        for p in token.replace("’", "'").split("-"):
            p = p.lower()
            p = p[2:] if p.startswith("o'") else p
            if p in self.surnames:
                continue
            if not any(p[:k] in self.heads and p[k:] in self.tails for k in range(3, len(p) - 1)):
                return False
        return True


_GIVEN_BEFORE = re.compile(r"(?<![\w@.'’-])([A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’]+)((?:[ \t]+[A-Z]\.)?[ \t]+|[ \t]*\n[ \t]*)$")
_INITIAL_BEFORE = re.compile(r"(?<![\w@'’-])((?:[A-Z]\.[ \t]*){1,3})[ \t]*$")
_TITLE_BEFORE = re.compile(rf"(?<!\w){_TITLE}[ \t]+$")
_GIVEN_AFTER = re.compile(r",[ \t\n]+([A-Z][A-Za-zÀ-ÖØ-öø-ÿ]+)(?:[ \t]+[A-Z]\.)?(?![\w@])")
_SUFFIX_AFTER = re.compile(r",?[ \t]+(?:Jr|Sr|JR|SR|II|III|IV)\b\.?")


#: Words that introduce a person.
_CAPTION_BEFORE = re.compile(r"\b(?:contact|attn|attention|buyer|signed|signature|dear|affiant|prepared by|submitted by|witness)[.:,]?[ \t]+$", re.I)


def _runs(s: str, tokens: list[re.Match], common: frozenset[str]) -> Iterator[list[re.Match]]:
    """Runs of two or more capitalised words on one line, without the common words at their ends."""

    def trimmed(run: list[re.Match]) -> list[re.Match]:
        low = [m[0].lower() for m in run]
        i, j = 0, len(run)
        while i < j and (low[i] in common or low[i] in _NOT_GIVEN):
            i += 1
        while j > i and (low[j - 1] in common or low[j - 1] in _NOT_GIVEN):
            j -= 1
        return run[i:j]

    run: list[re.Match] = []
    for m in tokens:
        if run:
            gap = s[run[-1].end() : m.start()]
            if gap == " " or _INITIAL_GAP.fullmatch(gap) or (gap.isspace() and "\n" not in gap):
                run.append(m)
                continue
            if len(run) > 1 and len(own := trimmed(run)) > 1:
                yield own
        run = [m]
    if len(run) > 1 and len(own := trimmed(run)) > 1:
        yield own


def suspects(s: str, found: list[tuple], beside: list[re.Match], names: Names, model: Model | None) -> tuple[list[tuple[int, int, tuple[str, ...]]], list[tuple[tuple[str, ...], bool]]]:
    """Names (start, end, features) whose surname no rule knows, in the order in which they hold, and the cases that train the classifier.

    Names after a title, a usual given name or a caption have no features; the others are names if the classifier takes them for such. A case is
    the features of a run and whether it meets a name that the lexicon's rules find; parts of e-mail addresses are none.
    """
    common = model.common if model else frozenset()

    def fits(a: int, b: int) -> bool:
        return not _AFTER_FIRM.match(s, b) and not _BEFORE_FIRM.search(s[max(0, a - 12) : a]) and not _PLACE.search(s[a:b])

    out, cases = [], []
    for k, m in enumerate(beside[:-1]):
        if m[0] in TITLES or m[0] in DOTTED_TITLES:
            gap = s[m.end() : beside[k + 1].start()]
            if beside[k + 1][0] in TITLES or beside[k + 1][0] in DOTTED_TITLES:
                continue
            if (gap.startswith(".") and m[0] in DOTTED_TITLES and gap[1:].strip(" \t") == "") or (m[0] in TITLES and gap.strip(" \t") == ""):
                last = k + 1
                while last < min(k + 3, len(beside) - 1) and beside[last + 1][0].lower() not in common and re.fullmatch(r"[ \t]+(?:[A-Z]\.[ \t]*)?", s[beside[last].end() : beside[last + 1].start()]):
                    last += 1
                out.append((beside[k + 1].start(), beside[last].end(), ()))
    known = [x for x in found if x[2] in ("name", "email")]
    for run in _runs(s, beside, common):
        start, end = run[0].start(), run[-1].end()
        features = tuple(model.features(s, run)) if model else ()
        if features:
            meets = [x[2] for x in known if x[0] < end and start < x[1]]
            if "email" not in meets:
                cases.append((features, bool(meets)))
        for k, m in enumerate(run[:-1]):
            if m[0].lower() in names.usual and run[k + 1][0].lower() not in common:
                out.append((m.start(), run[k + 1].end() if len(run) != k + 3 else run[k + 2].end(), ()))
                break
        else:
            if features:
                out.append((start, end, () if _CAPTION_BEFORE.search(s[max(0, start - 24) : start]) else features))
    return [x for x in out if fits(*x[:2])], cases


def _names(s: str, names: Names, tokens: list[re.Match]) -> Iterator[tuple[int, int]]:
    for m in tokens:
        token = m[0]
        if not names.is_surname(token):
            continue
        start, end = m.span()
        window = s[max(0, start - 40) : start]
        ok = False
        if g := _GIVEN_BEFORE.search(window):
            word = g[1].lower()
            if word not in _NOT_GIVEN and not ("\n" in g[2] and word not in names.given) and (word in names.given or not names.is_surname(g[1])):
                start = start - len(window) + g.start(1)
                ok = True
        if not ok and (g := _INITIAL_BEFORE.search(window)):
            start = start - len(window) + g.start(1)
            ok = True
        titled = _TITLE_BEFORE.search(window)
        if not ok and not titled and (g := _GIVEN_AFTER.match(s, end)):
            word = g[1].lower()
            if word in names.given or (word not in _NOT_GIVEN and token.isupper() == g[1].isupper() and not names.is_surname(g[1])):
                end, ok = g.end(), True
        if not ok and not titled:
            continue
        if x := _SUFFIX_AFTER.match(s, end):
            end = x.end()
        if _AFTER_FIRM.match(s, end) or _BEFORE_FIRM.search(s[max(0, start - 12) : start]):
            continue
        yield start, end


def _beside(s: str, tokens: list[re.Match]) -> list[re.Match]:
    """The capitalised words that may stand in one name, or title and name, with the word before or after; no rule over two words needs the others."""
    out: list[re.Match] = []
    for x, y in zip(tokens, tokens[1:]):
        a, b = x.end(), y.start()
        if (b - a == 1 or not s[a + 1].islower()) and (s[a] != "." or x[0] in DOTTED_TITLES) and _LINK.fullmatch(s, a, b):
            if not out or out[-1] is not x:
                out.append(x)
            out.append(y)
    return out


def look(text: str, names: Names) -> tuple[Text, list[tuple[int, int, str]], list[re.Match]]:
    """What a text tells by itself: its normal form, the items (start, end, kind) there that no other text decides, and the capitalised words that stand together."""
    t = normalised(text)
    s, found = t.s, []
    if "@" in s:
        for m in _EMAIL.finditer(s):
            found.append((m.start(), m.end(), "email"))
    seen = 0
    for c in _NUMERIC.finditer(s):
        # Patterns look around the whole text, but begin only at the stretch of digits, its sign, bracket or letters.
        lo, hi = max(seen, c.start() - 3), min(len(s), c.end() + 16)
        seen = c.end()
        if not _NUMBER.search(s, lo, hi):
            continue
        for p, needs in _IDS:
            for m in p.finditer(s, lo, hi):
                if m.start() < c.end() and (not needs or _CAPTION.search(s[max(0, m.start() - 60) : m.start()])):
                    found.append((m.start(), m.end(), "idnum"))
        for p in _PHONES:
            for m in p.finditer(s, lo, hi):
                if m.start() < c.end() and not _NOT_PHONE.search(s[max(0, m.start() - 16) : m.start()]):
                    found.append((m.start(), m.end(), "phone"))
    low = s.lower()
    for p, hints in zip(_ADDRESSES, _ADDRESS_HINTS):
        for h in hints:
            if h in low:
                for m in p.finditer(s):
                    found.append((m.start(), m.end(), "address"))
                break
    tokens = list(names.token.finditer(s))
    found += [(a, b, "name") for a, b in _names(s, names, tokens)]
    return t, found, _beside(s, tokens)


def placed(t: Text, spans: Iterable[tuple]) -> list[tuple]:
    """Spans (start, end, what) with their start and end in the source."""
    return [(a, b, x, t.back(a), t.back(b - 1) + 1) for a, b, x in spans]


def settle(found: list[tuple], maybe: list[tuple], model: Model | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each item in the source, from what ``look`` and ``suspects`` told, placed."""
    own = sorted(x[:2] for x in found if x[2] == "name")
    every = list(found)
    for a, b, features, *source in maybe:
        k = bisect_left(own, (b,)) - 1  # the last name that begins before b; names don't overlap
        if not (k >= 0 and own[k][1] > a) and (not features or model.score(features) >= model.least):
            insort(own, (a, b))
            every.append((a, b, "name", *source))
    every.sort(key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for a, b, kind, start, end in every:
        if a >= last:
            out.append((kind, start, end))
            last = b
    return out


def items(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each item in the source, positions from 0, in order and without overlap."""
    if not text:
        return []
    t, found, beside = look(text, names)
    return settle(placed(t, found), placed(t, suspects(t.s, found, beside, names, names.model)[0]), names.model)


KINDS = ("email", "phone", "idnum", "address", "name")
#: Columns that hold what ``look`` tells: placed items with their kind's number and the starts of words, each in one list, and whether the normal form is the text.
_LOOK = ["__found", "__starts", "__same"]
#: Columns that hold what ``suspects`` tells: placed names with the number of their features, and those features, each in one list.
_MAYBE = ["__maybe", "__why"]
_INTS, _STRINGS = pa.list_(pa.int32()), pa.list_(pa.string())
_WORD_COUNTS = pa.list_(pa.struct([("word", pa.string()), ("small", pa.int64()), ("capital", pa.int64())]))
_CASE_COUNTS = pa.list_(pa.struct([("f", _STRINGS), ("names", pa.int64()), ("others", pa.int64())]))
_ITEMS = pa.list_(pa.struct([("pii_kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def _lists(b: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in columns])


def _first(rows: list[dict], n: int) -> list:
    """The counts of a batch stand in the first of its ``n`` rows."""
    return [rows, *[None] * (n - 1)]


def seen(df: DataFrame, given: list[str], surnames: list[str], text: str) -> DataFrame:
    """``df`` with what each text tells by itself and the counts of its words, written out."""
    added = T.StructType.fromDDL("__found array<int>, __starts array<int>, __same boolean, __words array<struct<word string, small bigint, capital bigint>>")
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, surnames)
        for b in batches:
            if not b.num_rows:
                continue
            every, starts, same, words = [], [], [], Words()
            for (x,) in _lists(b, text):
                t, found, beside = look(x or "", names)
                words.add(t.s, beside)
                every.append([n for p, q, kind, *source in placed(t, found) for n in (p, q, KINDS.index(kind), *source)])
                starts.append([m.start() for m in beside])
                same.append(t.s == (x or ""))  # no transducer lengthens a text, so equal ones have equal positions
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(every, _INTS), pa.array(starts, _INTS), pa.array(same, pa.bool_()), pa.array(_first(words.rows(), b.num_rows), _WORD_COUNTS)], [*b.schema.names, *_LOOK, "__words"])

    return write_out(df.mapInArrow(run, schema))


def suspected(told: DataFrame, given: list[str], surnames: list[str], model: Model | None, text: str, columns: list[str]) -> DataFrame:
    """``columns`` of what ``seen`` gave, the names that ``model`` is to judge, and the counts of its cases, written out."""
    added = T.StructType.fromDDL("__maybe array<int>, __why array<string>, __cases array<struct<f array<string>, names bigint, others bigint>>")
    kept = [told.schema[c] for c in [*columns, "__found"]]
    sent = told.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, surnames)
        for b in batches:
            if not b.num_rows:
                continue
            every, why, counts = [], [], defaultdict(lambda: [0, 0])
            for x, flat, starts, same in _lists(b, text, *_LOOK):
                own, features = [], []
                if starts:
                    t = Text(x) if same else normalised(x)
                    found = [(flat[k], flat[k + 1], KINDS[flat[k + 2]]) for k in range(0, len(flat), 5)]
                    maybe, cases = suspects(t.s, found, names.at(t.s, starts), names, sent.value)
                    for f, y in cases:
                        counts[f][not y] += 1
                    for p, q, f, *source in placed(t, maybe):
                        own += (p, q, len(f), *source)
                        features += f
                every.append(own)
                why.append(features)
            rows = [{"f": list(f), "names": y, "others": n} for f, (y, n) in counts.items()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c.name)) for c in kept], pa.array(every, _INTS), pa.array(why, _STRINGS), pa.array(_first(rows, b.num_rows), _CASE_COUNTS)], [*[c.name for c in kept], *_MAYBE, "__cases"])

    return write_out(told.select(*[f"`{c}`" for c in dict.fromkeys([*columns, text, *_LOOK])]).mapInArrow(run, T.StructType([*kept, *added.fields])))


def _sums(df: DataFrame, key: str, *counts: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def trained(told: DataFrame, given: list[str], surnames: list[str], text: str, columns: list[str]) -> tuple[Model | None, DataFrame]:
    """The classifier of names from all texts that ``seen`` gave, and what it is to judge. Only its words, features and numbers of scores come to the driver."""
    words = _sums(told.where("__words is not null").select(F.explode("__words").alias("w")).select("w.*"), "word", "small", "capital")
    model = Model(frozenset(r.word for r in words.where(f"capital > 0 and small * {COMMON} >= capital").select("word").collect()))
    judged = suspected(told, given, surnames, model, text, columns)
    cases = write_out(_sums(judged.where("__cases is not null").select(F.explode("__cases").alias("c")).select("c.*"), "f", "names", "others"))
    tally = lambda df, key: {r[0]: (r[1], r[2]) for r in _sums(df, key, "names", "others").collect()}
    if not model.weigh(tally(cases.select(F.explode("f").alias("x"), "names", "others"), "x")):
        return None, suspected(told, given, surnames, None, text, columns)
    sent = told.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.score(f) for f in b.column(0).to_pylist()], pa.int64()), *b.columns[1:]], ["x", "names", "others"])

    model.limit(tally(cases.mapInArrow(score, "x long, names long, others long"), "x"))
    return model, judged


def redact(df: DataFrame, lexicon: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Adds ``redacted``, the text with placeholders such as ``[EMAIL]``, and ``items`` (kind, start_pos, end_pos).

    Columns of these names are replaced. ``lexicon`` (name_part, part_kind) is a small table that does not grow; it is sent to the workers.
    Only ``columns`` of the result are made, if they are given.
    """
    parts = [(r[0], r[1]) for r in lexicon.where("name_part is not null").select("name_part", "part_kind").collect()]
    given, surnames = ([a for a, b in parts if b == k] for k in ("given", "surname"))
    df = df.drop(*[c for c in ("redacted", "items") if c != text])
    added = T.StructType.fromDDL("redacted string, items array<struct<pii_kind string, start_pos int, end_pos int>>")
    schema = T.StructType([x for x in [*df.schema.fields, *added.fields] if columns is None or x.name in columns])
    made = {x.name for x in added.fields} & set(schema.names) - set(df.columns)
    kept = [c for c in df.columns if c in schema.names or c == text and "redacted" in made]
    model, judged = trained(seen(df, given, surnames, text), given, surnames, text, kept)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed, lists = [], []
            texts = b.column(b.schema.get_field_index(text)).to_pylist() if "redacted" in made else [None] * b.num_rows
            for x, (flat, names, why) in zip(texts, _lists(b, "__found", *_MAYBE)):
                found = [(flat[k], flat[k + 1], KINDS[flat[k + 2]], *flat[k + 3 : k + 5]) for k in range(0, len(flat), 5)]
                maybe, at = [], 0
                for k in range(0, len(names), 5):
                    maybe.append((names[k], names[k + 1], why[at : at + names[k + 2]], *names[k + 3 : k + 5]))
                    at += names[k + 2]
                own = settle(found, maybe, sent.value)
                lists.append([{"pii_kind": k, "start_pos": a + 1, "end_pos": z} for k, a, z in own])
                if "redacted" in made:
                    parts, last = [], 0
                    for k, a, z in own:
                        parts += [x[last:a], f"[{k.upper()}]"]
                        last = z
                    fixed.append(None if x is None else "".join([*parts, x[last:]]))
            new = {"redacted": (fixed, pa.string()), "items": (lists, _ITEMS)}
            yield pa.RecordBatch.from_arrays([pa.array(*new[c]) if c in made else b.column(b.schema.get_field_index(c)) for c in schema.names], schema.names)

    return judged.drop("__cases").mapInArrow(run, schema)


def marked(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return redact(docs, table(spark, sf_dir, "name_lexicon"), columns=["doc_id", column])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: every item of personal data."""
    return marked(spark, sf_dir, "items").select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.pii_kind", F.col("i.start_pos").cast("bigint").alias("start_pos"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_redacted: every document's readable text without its personal data."""
    return marked(spark, sf_dir, "redacted")
