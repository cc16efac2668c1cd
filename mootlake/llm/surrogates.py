"""Surrogates for personal data: keyed, of the same type and form, and distinct for distinct entities.

Entities are found by pattern (addresses, numbers) and by name lists and titles (names).  A surrogate is a keyed permutation
of the entity inside its own form: digits stay digits in the same places, case and script stay, a first name becomes one of
the same gender and script, a card keeps its network digit and the validity of its check digit, a private network address
stays private.  Being permutations, surrogates of different entities differ, equal entities get equal surrogates wherever
they occur, and nothing has to be shared between tasks.  Name parts are replaced one by one, so "Mr. Brown" and
"Anna Brown" still share their family name.  A name is the whole run of capitalised parts behind titles or a listed first
name; its parts are then replaced wherever they stand by themselves, with a capital, in the same text.

Permutations have no fixed points, so no original is its own surrogate.  The collision check groups all entities by type and
surrogate; if two originals met in one, or an original stayed as it is, the run would be repeated with the next key.

Defined results: null texts stay null, empty texts stay empty, both without entities; overlapping findings go to the one
that begins first, then the longer; texts and entities of any length are read whole, in linear time; repeated rows get equal results; an empty table gives an empty result; other columns
are not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

DEFAULT_KEY = b"mootlake surrogate key, replace per corpus"
MAX_REKEYS = 8
PIECE = 48  # digits or letters that are permuted as one number; its halves fit the 128 bits of a digest

# First names by gender and script, and titles by gender.
FIRST_NAMES = {
    ("f", "latin"): "anna maria emma julia laura sarah lisa nina elena sofia clara marie claire camille lucie carmen lucia isabel "
                    "pilar rosa mary linda susan karen nancy helen sandra emily alice jane kate olivia ursula monika petra sabine",
    ("m", "latin"): "john james robert michael william david richard thomas charles daniel peter paul mark george kevin brian "
                    "hans klaus jürgen stefan markus pierre jean luc antoine henri carlos juan miguel javier pablo luis jorge "
                    "andreas oliver martin",
    ("f", "cyrillic"): "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия",
    ("m", "cyrillic"): "иван алексей сергей дмитрий андрей михаил николай владимир павел олег",
}
TITLES = {"m": "mr mister herr monsieur señor sr sir", "f": "mrs ms miss frau madame mme mlle señora sra fräulein",
          "n": "dr prof doctor professor"}

# Words inside a name that stay as they are, and words that end one even with a capital.
PARTICLES = frozenset("van von vom zu zum zur der den de la las los del della di da do dos du des le ten ter bin ibn al el y e".split())
STOPS = frozenset("i a an and or but of the in on at for to is was are were has had said says with from by he she it they we you this that "
                  "und oder aber die das dem ist war hat im am mit er sie es wir et ou mais les est dans pour il elle o pero es en que un una "
                  "и или но в на с он она не".split())

GENDER_OF_TITLE = {t: g for g, line in TITLES.items() for t in line.split()}
CLASS_OF_NAME = {n: c for c, line in FIRST_NAMES.items() for n in line.split()}

_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[\w-]*\.)+[A-Za-z]{2,24}(?![\w-])")
_NUMBERS = re.compile(r"""
 (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w))
|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d))
|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
|(?P<card>(?<![\w.+])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))
|(?P<phone>(?<![\w.+])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}
   |\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,4}[ /.-]\d{3,8}(?:[ -]\d{2,5})*)(?!\w|[.-]\d))
""", re.X)
_PART = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_GAP, _DOT_GAP = re.compile(r"[ \t\xa0]+"), re.compile(r"\.?[ \t\xa0]+")
_BEGIN = re.compile(r"[+(]?[0-9]|[A-Z]{2}[0-9]{2}")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME_WORDS = {w for n in (*CLASS_OF_NAME, *GENDER_OF_TITLE) for w in n.split("-")}


# ---------------------------------------------------------------- keyed permutations

class Permuter:
    """Permutations of number ranges, letters and names under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.names = {}
        for group, line in FIRST_NAMES.items():
            ordered = sorted(line.split(), key=lambda n: self._digest("name", n))
            # The next in keyed order: a permutation without fixed points.
            self.names |= dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
        self.number = lru_cache(maxsize=200_000)(self._number)

    def _digest(self, tweak: str, value) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{value}".encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def _number(self, value: int, size: int, tweak: str) -> int:
        """A permutation of range(size) without fixed points: the next in keyed order, as for names."""
        if size < 2:
            return value
        return self._walk((self._walk(value, size, tweak, False) + 1) % size, size, tweak, True)

    def _walk(self, value: int, size: int, tweak: str, back: bool) -> int:
        """Place of a value in keyed order, or back: a Feistel network over the next even number of bits, walked until it is in range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for turn in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ (self._digest(f"{tweak}/{size}/{turn}", left) & mask), left
                else:
                    left, right = right, left ^ (self._digest(f"{tweak}/{size}/{turn}", right) & mask)
            value = left << half | right
            if value < size:
                return value

    def digits(self, text: str, tweak: str) -> str:
        """Another string of as many digits; long ones piece by piece, which is a permutation of the whole as well."""
        if len(text) > PIECE:
            return "".join(self.digits(text[i:i + PIECE], f"{tweak}@{i}") for i in range(0, len(text), PIECE))
        return str(self.number(int(text), 10 ** len(text), tweak)).zfill(len(text)) if text else ""

    def letters(self, text: str, tweak: str) -> str:
        """Another string of as many letters a-z."""
        if len(text) > PIECE:
            return "".join(self.letters(text[i:i + PIECE], f"{tweak}@{i}") for i in range(0, len(text), PIECE))
        value = 0
        for c in text:
            value = value * 26 + ord(c) - 97
        value, out = self.number(value, 26 ** len(text), tweak), []
        for _ in text:
            value, c = divmod(value, 26)
            out.append(chr(97 + c))
        return "".join(reversed(out))

    def mixed(self, text: str, tweak: str) -> str:
        """Runs of a-z and of digits permuted, case kept, other characters as they are."""
        def change(m: re.Match) -> str:
            run = m[0]
            return self.digits(run, tweak) if run.isdigit() else like(run, self.letters(run.lower(), tweak))
        return re.sub(r"[0-9]+|[A-Za-z]+", change, text)


def like(model: str, text: str) -> str:
    """``text`` in the case of ``model``."""
    if model.isupper() and len(model) > 1:
        return text.upper()
    if len(model) == len(text):
        return "".join(t.upper() if m.isupper() else t for m, t in zip(model, text, strict=True))
    return text[:1].upper() + text[1:] if model[:1].isupper() else text


def luhn(body: str) -> int:
    """Check digit of a number without its last digit."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def refill(model: str, digits: str) -> str:
    """``model`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in model)


# ---------------------------------------------------------------- one function per type

def _email(p: Permuter, value: str) -> str:
    local, _, domain = value.rpartition("@")
    labels = domain.split(".")
    # Reserved names stay; any other domain ends up below a reserved one, so that no mail reaches anyone.
    keep = 2 if len(labels) >= 2 and labels[-2].lower() == "example" else 0
    head = [p.mixed(x, "domain") for x in labels[:len(labels) - keep]] if keep else [*(p.mixed(x, "domain") for x in labels[:-1]), labels[-1], "example"]
    return f"{p.mixed(local, 'local')}@{'.'.join(head + labels[len(labels) - keep:] if keep else head)}"


def _card(p: Permuter, value: str) -> str:
    digits = re.sub(r"\D", "", value)
    off = (int(digits[-1]) - luhn(digits[:-1])) % 10
    body = digits[0] + p.digits(digits[1:-1], f"card{digits[0]}{off}")
    return refill(value, body + str((luhn(body) + off) % 10))


def _phone(p: Permuter, value: str) -> str:
    digits = re.sub(r"\D", "", value)
    code = re.match(r"\+(\d{1,3})(?=\D)", value)
    head = code[1] if code else digits[:1]
    return refill(value, head + p.digits(digits[len(head):], f"phone{head}"))


def _ip(p: Permuter, value: str) -> str:
    parts = [int(x) for x in value.split(".")]
    number = sum(x << s for x, s in zip(parts, (24, 16, 8, 0), strict=True))
    for base, bits in ((0x0A000000, 24), (0x7F000000, 24), (0xC0A80000, 16), (0xAC100000, 20)):
        if number >> bits == base >> bits:
            changed = base | p.number(number & (1 << bits) - 1, 1 << bits, "ip")
            break
    else:
        private = lambda x: x >> 24 in (10, 127) or x >> 16 == 0xC0A8 or x >> 20 == 0xAC1
        changed = p.number(number, 1 << 32, "ip")
        while private(changed):
            changed = p.number(changed, 1 << 32, "ip")
    return ".".join(str(changed >> s & 255) for s in (24, 16, 8, 0))


def _ssn(p: Permuter, value: str) -> str:
    return refill(value, p.digits(re.sub(r"\D", "", value), "ssn"))


def _iban(p: Permuter, value: str) -> str:
    plain = value.replace(" ", "")
    runs = re.findall(r"\d+|[A-Z]+", plain[4:])
    if not any(x.isdigit() for x in runs):
        runs = [p.letters(x.lower(), "iban").upper() for x in runs]
    body = "".join(p.digits(x, "iban") if x.isdigit() else x for x in runs)
    whole = body + plain[:2] + "00"
    check = 98 - int("".join(str(int(c, 36)) for c in whole)) % 97
    fresh, left = f"{plain[:2]}{check:02d}{body}", 0
    out = []
    for c in value:
        out.append(c if c == " " else fresh[left])
        left += c != " "
    return "".join(out)


_CONSONANTS, _VOWELS = "bdfghklmnprstvwzcjqx", "aeiou"
_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS = "бвгдзклмнпрстфхцчшжщ", "аеиоу"


def _family(p: Permuter, part: str) -> str:
    """A pronounceable name for a part of a family name; different for different parts."""
    lower = part.lower()
    cyrillic = "а" <= lower[0] <= "я"
    if len(lower) > PIECE:  # a keyed digest stands for a run of letters that no family has; the check sees collisions
        digest = p._digest("family", lower)
        lower = "".join(chr(97 + digest // 26 ** i % 26) for i in range(27))
    if all("a" <= c <= "z" for c in lower):
        base, first, ending = 26, 97, ""
    elif all("а" <= c <= "я" for c in lower):
        base, first, ending = 32, ord("а"), ""
    elif all("a" <= c <= "z" or "ß" <= c <= "ÿ" for c in lower):
        letters = {c: i for i, c in enumerate(map(chr, (*range(97, 123), *range(0xDF, 0x100))))}
        lower = "".join(chr(letters[c]) for c in lower)
        base, first, ending = len(letters), 0, "n"
    else:
        base, first, ending = 0x110000, 0, "с" if cyrillic else "s"
    value = 0
    for c in lower:
        value = value * base + ord(c) - first
    value = p.number(value, base ** len(lower), f"family{base}") + sum(base ** i for i in range(1, len(lower)))
    consonants, vowels = (_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS) if cyrillic else (_CONSONANTS, _VOWELS)
    out = []
    while True:
        value, syllable = divmod(value, 100)
        out.append(consonants[syllable // 5] + vowels[syllable % 5])
        if not value:
            break
        value -= 1
    if not ending and "".join(out) == lower:
        ending = "р" if cyrillic else "r"  # of odd length, as no other
    return like(part, "".join(out) + ending)


def _name_part(p: Permuter, part: str) -> str:
    if len(part) == 1 and "a" <= part.lower() <= "z":
        return like(part, p.letters(part.lower(), "initial"))
    pieces = [x for x in re.split(r"([-'’])", part) if x]
    return "".join(x if x in "-'’" else like(x, p.names[x.lower()]) if x.lower() in p.names else _family(p, x) for x in pieces)


_MAKERS = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "iban": _iban, "name": _name_part}


# ---------------------------------------------------------------- finding

def find_names(text: str) -> list[tuple[int, int]]:
    """Places of all name parts: runs behind titles and listed first names, then every other mention of their parts."""
    words = list(_PART.finditer(text))
    lower = [w[0].lower() for w in words]
    capital = [w[0][0].isupper() for w in words]

    def follows(i: int, dot: bool) -> bool:
        """Whether the next word stands right behind word ``i``."""
        return i + 1 < len(words) and (_DOT_GAP if dot else _GAP).fullmatch(text, words[i].end(), words[i + 1].start()) is not None

    def run(i: int, least: int) -> list[int]:
        """Name parts from word ``i`` on; stop words count among the first ``least`` only."""
        out: list[int] = []
        while True:
            dot = len(lower[i]) == 1 or lower[i] in GENDER_OF_TITLE
            onward = follows(i, dot)
            named = onward and (capital[i + 1] or lower[i + 1] in PARTICLES)
            if out and lower[i] in GENDER_OF_TITLE and onward and capital[i + 1]:
                return out  # the title of the next name
            if lower[i] not in PARTICLES or (capital[i] and not named):
                if not capital[i] or (len(out) >= least and lower[i] in STOPS):
                    return out
                out.append(i)
            if not onward:
                return out
            i += 1

    def body(i: int) -> str:
        """The word without a possessive ending."""
        return words[i][0][:-2] if lower[i][-2:] in ("'s", "’s") else words[i][0]

    taken: set[int] = set()
    titles: set[int] = set()
    i = 0
    while i < len(words):
        parts: list[int] = []
        if lower[i] in GENDER_OF_TITLE:
            first = i
            while follows(i, True) and lower[i + 1] in GENDER_OF_TITLE:
                i += 1
            parts = run(i + 1, 1) if follows(i, True) else []
            titles |= set(range(first, i + 1)) if parts or i > first else set()
            if not parts and i > first and capital[i] and GENDER_OF_TITLE[lower[i]] != "n":
                parts = [i]  # nobody is addressed twice: a family name that looks like a title
        elif capital[i] and re.split("[-'’]", lower[i])[0] in CLASS_OF_NAME:
            parts = run(i, 2)
            if len(parts) < 2 and not (follows(i, False) and capital[i + 1]):
                parts = []
        taken |= set(parts)
        i = max([i, *parts]) + 1
    whole = {body(i).lower() for i in taken} - STOPS
    pieces = {x for w in whole for x in _LETTERS.findall(w) if len(x) > 1} - STOPS - PARTICLES
    whole = {w for w in whole if len(w) > 1}
    out = []
    for i, w in enumerate(words):
        start, end = w.start(), w.start() + len(body(i))
        if i in taken:
            out.append((start, end))
        elif i in titles or text[w.end():w.end() + 1].isalnum() or text[w.end():w.end() + 1] == "_":
            continue
        elif capital[i] and body(i).lower() in whole:
            out.append((start, end))
        else:
            out += [(start + m.start(), start + m.end()) for m in _LETTERS.finditer(body(i)) if m[0][0].isupper() and m[0].lower() in pieces]
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of all entities, in order and apart from each other."""
    found = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)] if "@" in text else []
    done = 0
    for begin in _BEGIN.finditer(text):
        # Only at places where a number can begin, and behind the last one.
        if begin.start() >= done and (m := _NUMBERS.match(text, begin.start())):
            if m.lastgroup != "phone" or 7 <= len(re.sub(r"\D", "", m[0])) <= 15:
                found.append((m.start(), m.end(), m.lastgroup))
                done = m.end()
    if not _NAME_WORDS.isdisjoint(_LETTERS.findall(text.lower())):
        found += [(start, end, "name") for start, end in find_names(text)]
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def replace(p: Permuter, text: str | None) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and its entities with places in the new text and a keyed mark of the original."""
    if not text:
        return text, []
    pieces, entities, at, length = [], [], 0, 0
    for start, end, kind in find(text):
        value = text[start:end]
        fresh = _MAKERS[kind](p, value)
        pieces += [text[at:start], fresh]
        length += start - at
        entities.append({"type": kind, "start": length, "end": length + len(fresh), "surrogate": fresh,
                         "mark": hashlib.blake2b(f"{kind}|{value.lower()}".encode(), key=p.key[:64], digest_size=12).hexdigest(),
                         "changed": fresh != value})
        length += len(fresh)
        at = end
    pieces.append(text[at:])
    return "".join(pieces), entities


ENTITIES = "array<struct<type:string,start:int,end:int,surrogate:string,mark:string,changed:boolean>>"


def pseudonymised(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text, n_entities, entities of every row, without the check."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = Permuter(key)
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()),
                                   ("mark", pa.string()), ("changed", pa.bool_())]))
        for batch in batches:
            texts, entities = zip(*(replace(p, t) for t in batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in entities], pa.int64()), pa.array(entities, kind)],
                names=["doc_id", "text", "n_entities", "entities"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key_type}, text string, n_entities bigint, entities {ENTITIES}")


def collisions(rows: DataFrame) -> DataFrame:
    """(type, surrogate) that stand for more than one original or for themselves; case counts as form, not as identity."""
    each = rows.select(F.inline("entities")).groupBy("type", "surrogate", "mark").agg(F.bool_and("changed").alias("changed"))
    return (each.groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("originals"), F.bool_and("changed").alias("changed"))
            .where("originals > 1 OR NOT changed"))


def surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """Written table doc_id, text, n_entities, entities whose surrogates passed the collision check."""
    for turn in range(MAX_REKEYS):
        rows = stage_table(pseudonymised(docs, key + bytes([turn]) if turn else key), "surrogates")
        if not collisions(rows).take(1):
            return rows
    raise ValueError(f"surrogates still collide under {MAX_REKEYS} keys")
