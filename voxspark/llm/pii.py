"""Surrogates for personal data: keyed, type-consistent and collision-checked.

Entities are found by pattern. Each is written as digits of a mixed radix over the characters that may
vary (a digit, a hexadecimal digit, a vowel or a consonant of its script and case, a letter of its part
of Unicode, an octet of an address, an entry of a list of given names) and sent through a keyed Feistel
network over just that domain. That is a one-to-one map onto values of the same format, so different
entities of a format stay different, equal ones stay equal in every document, and names keep gender,
script and case. Card numbers and IBANs that pass their check still do. Surrogates that some document
really holds, the entity itself among them, and those that two entities share are found by a join and
drawn again with another tweak until none is left; where a format has too few values, names grow.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import map_rows

# Given names by gender and script, and titles that say a name follows.
MALE = "james john robert michael david william richard thomas daniel paul mark george peter hans klaus jürgen pierre jean luc antonio carlos luis jorge pablo".split()
FEMALE = "mary linda susan karen nancy lisa anna emma sarah laura julia alice claire marie sophie heike sabine ursula petra maria carmen lucia elena rosa".split()
MALE_CYRILLIC = "иван пётр сергей алексей дмитрий николай михаил андрей".split()
FEMALE_CYRILLIC = "анна мария елена ольга наталья ирина татьяна светлана".split()
TITLES_MALE = "Mr Herr Herrn Monsieur Señor Sr Sir Lord господин г-н".split()
TITLES_FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Mademoiselle Señora Sra Señorita Srta Lady госпожа г-жа".split()
# Titles of either gender, also after another title, and one that is a title only with a full stop.
TITLES_EITHER = "Dr Doctor Doktor Docteur Doctora Prof Professor Professeur Profesor Profesora доктор профессор".split()
TITLES_DOTTED = ["M"]
# Titles that are written in capitals too, before two words of capitals.
TITLES_LOUD = "MR MRS MISS HERR FRAU MONSIEUR MADAME MME SEÑOR SEÑORA SRA DR DOCTOR PROF PROFESSOR".split()
# Words that follow a given name without being a surname.
NO_SURNAMES = frozenset("the this that these those and or of in on at to for with by from is was has had will who which der die das und oder von mit ist war hat le la les et ou de du des est el los las y o del es".split())
# Country codes of telephone numbers that have one and two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_LISTS = {"given_m": MALE, "given_f": FEMALE, "given_m_cyrillic": MALE_CYRILLIC, "given_f_cyrillic": FEMALE_CYRILLIC}
_GIVEN = {name: kind for kind, names in _LISTS.items() for name in names}
_ALPHABETS = [("aeiou", "bcdfghjklmnpqrstvwxyz"), ("àáâãäåèéêëìíîïòóôõöùúûü", "çñß"), ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), ("αεηιουω", "βγδζθκλμνξπρσςτφχψ")]
_CLASS = {c: group for pair in _ALPHABETS for group in pair for c in group}
_ROUNDS = 8
#: Draws of a surrogate before names grow by a letter for each further one, and before a format counts as full.
DRAWS, MOST_DRAWS = 6, 40


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> str:
    """The lower-case letters that may stand for the letter ``c``: those of a list, or those of its script, kind and
    row of 256 in Unicode; accented Latin vowels and consonants keep apart."""
    if c in _CLASS:
        return _CLASS[c]

    def kind(x: str) -> tuple:
        script = unicodedata.name(x, " ").split()[0]
        base = unicodedata.normalize("NFD", x)[0] in "aeiouy" if script == "LATIN" else None
        return script, unicodedata.category(x), base

    def fits(x: str) -> bool:
        cased = x.upper() != x or unicodedata.category(x) == "Lo"
        return cased and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x

    row = ord(c) >> 8
    return "".join(x for x in map(chr, range(row << 8, (row + 1) << 8)) if unicodedata.category(x)[0] == "L" and fits(x) and kind(x) == kind(c))


def _letters_for(c: str) -> str:
    """The alphabet of a letter in either case; empty for what is no letter, or changes length with its case."""
    low = c.lower()
    if not c.isalpha() or len(low) != 1 or len(low.upper()) != 1 or c not in (low, low.upper()):
        return ""
    found = _alphabet(low)
    return found if low in found else ""

_WORD = r"[^\W\d_]+"
#: A name: words joined by hyphens and apostrophes, without the ending of the genitive.
_NAME = rf"{_WORD}(?:['’-](?!s(?!\w)){_WORD})*"
#: What begins with a capital, or has a script without them.
_CAPITAL = r"(?=[^\W\d_a-zß-öø-ÿа-яё])"


def _any(words: list[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_TITLE = rf"(?:(?:{_any([*TITLES_MALE, *TITLES_FEMALE, *TITLES_EITHER])})\.?|(?:{_any(TITLES_DOTTED)})\.)"
_LOUD = r"[^\W\d_a-zß-öø-ÿа-яё]{2,}(?:['’-][^\W\d_a-zß-öø-ÿа-яё]+)*(?!\w)"
_LOUD_TITLE = rf"(?:{_any(TITLES_LOUD)})\.?"
PATTERNS = {
    "email": r"(?<![\w.+-])\w[\w.+-]*@(?:[\w-]+\.)+[^\W\d_]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "jwt": r"(?<![\w-])eyJ[\w-]{6,}\.eyJ[\w-]{6,}\.[\w-]{6,}(?![\w-])",
    "api_key": r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|[sp]k_(?:live|test)_[0-9A-Za-z]{10,99}|xox[abprs]-[0-9A-Za-z-]{10,72})(?![\w-])",
    "password": r"(?<![\w])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]asswort|[Pp]wd)[\"']?[ \t]*[:=][ \t]*[\"']?[^\s\"'<>;,]{4,}",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![0-9A-Za-z])(?:[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?|[a-z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?)(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w+(.,/-])0\d{1,4}[ /-]\d{5,8}(?![\w/-])|(?<![\w+.,-])[2-9]\d{9}(?![\w]|[.,]\d)",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?<!\w)(?:{_TITLE}(?:[ \t]{_TITLE}(?!\w))*[ \t]{_CAPITAL}{_NAME}(?:[ \t]{_CAPITAL}{_NAME})?|{_LOUD_TITLE}[ \t]{_LOUD}[ \t]{_LOUD})",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
#: No entity stands in a text that has none of these.
_SIGN = re.compile(rf"[0-9@]|AKIA|gh[pousr]_|[sp]k[-_]|xox|eyJ|[0-9A-Fa-f]{{32}}|[0-9A-Fa-f]:|(?:assw|ASSW|wd)|(?<!\w)(?:{_TITLE}|{_LOUD_TITLE})[ \t]")
#: Two words with capitals: a name without a title where the first is a given name.
_PAIR = re.compile(rf"(?<!\w)(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])({_NAME})[ \t]{_CAPITAL}({_NAME})")

MENTION = "kind string, start int, stop int, value string"


# --- one-to-one maps ---------------------------------------------------------------------------------


def _draw(key: bytes, tweak: str, number: int, value: int, size: int) -> int:
    digest = hmac.new(key, f"{tweak}|{number}|{value}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest, "big") % size


def permute(key: bytes, tweak: str, digits: list[int], radix: list[int]) -> list[int]:
    """A keyed permutation of all vectors of ``digits`` below ``radix``."""
    free = [i for i, r in enumerate(radix) if r > 1]
    if not free:
        return digits
    if len(free) == 1:
        r = radix[free[0]]
        order = sorted(range(r), key=lambda v: hmac.new(key, f"{tweak}|{v}".encode(), hashlib.sha256).digest())
        return [order[d] if i == free[0] else d for i, d in enumerate(digits)]
    halves = free[: len(free) // 2], free[len(free) // 2 :]

    def joined(places: list[int]) -> tuple[int, int]:
        value, size = 0, 1
        for i in places:
            value, size = value * radix[i] + digits[i], size * radix[i]
        return value, size

    (a, n_a), (b, n_b) = joined(halves[0]), joined(halves[1])
    for number in range(0, _ROUNDS, 2):
        a = (a + _draw(key, tweak, number, b, n_a)) % n_a
        b = (b + _draw(key, tweak, number + 1, a, n_b)) % n_b
    out = list(digits)
    for value, places in ((a, halves[0]), (b, halves[1])):
        for i in reversed(places):
            value, out[i] = divmod(value, radix[i])
    return out


def _hexadecimal(text: str) -> list[str]:
    """The digits that each character of ``text`` may become: all sixteen where its letters are of one case;
    in mixed case a figure stays a figure, and a letter one of its case. Other characters stay."""
    kinds = {c.islower() for c in text if c.isalpha()}
    if len(kinds) < 2:
        every = "0123456789ABCDEF" if kinds == {False} else "0123456789abcdef"
        return [every if c.isalnum() else "" for c in text]
    return ["" if not c.isalnum() else "0123456789" if c.isdigit() else "abcdef" if c.islower() else "ABCDEF" for c in text]


def _characters(key: bytes, tweak: str, text: str, fixed: set[int], hexadecimal: bool = False) -> str:
    """``text`` with each free character sent to another of its class: digits, or letters of its script,
    case and kind. Places in ``fixed``, and what has no class, stay."""
    groups: list[str] = _hexadecimal(text) if hexadecimal else []
    for i, c in enumerate(text if not hexadecimal else ""):
        if i in fixed:
            groups.append("")
        elif c.isascii() and c.isdigit():
            groups.append("0123456789")
        else:
            groups.append(_letters_for(c))
    shape = "".join(f"{'X' if c.isupper() else 'x'}{g[0]}" if g and c.isalpha() else "9" if g else c for g, c in zip(groups, text))
    digits = [g.index(c if c in g else c.lower()) if g else 0 for g, c in zip(groups, text)]
    made = permute(key, f"{tweak}|{shape}", digits, [len(g) or 1 for g in groups])
    return "".join((g[d].upper() if c.isupper() and not hexadecimal else g[d]) if g else c for g, d, c in zip(groups, made, text))


def _like(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.capitalize() if model[0].isupper() else word


def _luhn(digits: str) -> int:
    """The digit that makes ``digits`` and it pass the check of card numbers."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _card(key: bytes, tweak: str, value: str) -> str:
    """Another number of the form; its last digit is as far from the right one as before, so a valid number stays one."""
    places = [i for i, c in enumerate(value) if c.isdigit()]
    made = _characters(key, tweak, value, {places[-1]})
    off = int(value[places[-1]]) - _luhn("".join(value[i] for i in places[:-1]))
    last = (_luhn("".join(made[i] for i in places[:-1])) + off) % 10
    return f"{made[: places[-1]]}{last}{made[places[-1] + 1 :]}"


def _iban_check(value: str) -> int:
    compact = re.sub(r"[^0-9A-Z]", "", value.upper())
    return 98 - int("".join(str(int(c, 36)) for c in compact[4:] + compact[:2] + "00")) % 97


def _iban(key: bytes, tweak: str, value: str) -> str:
    """Another account of the country, its check digits as far from the right ones as before."""
    made = _characters(key, tweak, value, {0, 1, 2, 3})
    return f"{made[:2]}{(_iban_check(made) + int(value[2:4]) - _iban_check(value)) % 100:02d}{made[4:]}"


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an entity; another ``attempt`` gives another one.

    A given name becomes another of its list at first, later a name that keeps its ending. Names grow by a letter
    for each attempt from ``DRAWS`` on.
    """
    tweak = f"{kind}|{attempt}"
    if kind == "ipv4":
        octets = [int(p) for p in value.split(".")]
        return ".".join(map(str, permute(key, tweak, octets, [256] * 4)))
    if kind in ("secret", "ipv6"):
        return _characters(key, tweak, value, set(), hexadecimal=True)
    if kind == "api_key":
        return _characters(key, tweak, value, set(range(8 if value[2] == "_" else 4)))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        keep = set(range(domain.rfind("."), len(domain)))
        return f"{_characters(key, tweak, local, set())}@{_characters(key, tweak + '|domain', domain, keep)}"
    if kind == "phone":
        return _characters(key, tweak, value, set(range(_country(value))))
    if kind == "jwt":
        return _characters(key, tweak, value, {i + k for i in (0, value.find(".") + 1) for k in range(3)})
    if kind == "iban":
        return _iban(key, tweak, value)
    if kind == "card":
        return _card(key, tweak, value)
    if kind in _LISTS and not attempt:
        names = _LISTS[kind]
        return _like(value, names[permute(key, tweak, [names.index(value.lower())], [len(names)])[0]])
    if kind in _LISTS or kind == "surname":
        more = max(0, attempt - DRAWS + 1)
        letters = _letters_for(value[-1]) or "e"
        # what is put before the name is drawn from the whole of it, so that the domain grows
        longer = "".join(letters[_draw(key, tweak, i, zlib.crc32(value.encode()), len(letters))] for i in range(more))
        made = _characters(key, tweak, value, {len(value) - 1} if kind in _LISTS else set())
        return _like(value, longer + made.lower()) if more else made
    return _characters(key, tweak, value, set())


def _country(phone: str) -> int:
    """Characters of the country code, with its sign; without one, of what starts a number without brackets."""
    if phone[0] != "+":
        return int(phone[0] == "0" or phone.isdigit())
    digits = re.match(r"\d{1,3}", phone[1:])[0]
    return 1 + next((n for n in (1, 2) if digits[:n] in CODES), len(digits))


def _gendered(title: str) -> str:
    return "f" if title.rstrip(".").lower() in _FEMALE_TITLES else "m"


_FEMALE_TITLES = {t.lower() for t in TITLES_FEMALE}
_ALL_TITLES = frozenset([*TITLES_MALE, *TITLES_FEMALE, *TITLES_EITHER, *TITLES_LOUD])
_PASSWORD = re.compile(r"[:=][ \t]*[\"']?")


# --- detection ---------------------------------------------------------------------------------------


def detect(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, stop, value)`` of the entities of ``text``, in order and without overlap.

    A name after titles gives a mention for each of its words: given names of the lists by gender, else
    surnames. A given name of the lists before another word with a capital is a name without a title, unless that
    word is a function word or stands in the text in small letters too. Other bare mentions of a surname are mentions.
    """
    pairs = [m for m in _PAIR.finditer(text) if m[1].lower() in _GIVEN and m[2].lower() not in NO_SURNAMES]
    if not pairs and not _SIGN.search(text):
        return []
    found, surnames = [], set()
    for m in _ANY.finditer(text):
        if m.lastgroup == "password":
            start = m.start() + _PASSWORD.search(m[0]).end()
            found.append(("password", start, m.end(), text[start : m.end()]))
        elif m.lastgroup != "name":
            found.append((m.lastgroup, m.start(), m.end(), m[0]))
        else:
            gender, titled = "m", True
            for w in re.finditer(r"[^\s.]+", m[0]):
                if titled and (w[0] in _ALL_TITLES or m[0][w.start() : w.end() + 1] in ("M.",)):
                    gender = "f" if _gendered(w[0]) == "f" else gender
                    continue
                titled = False
                kind = _GIVEN.get(w[0].lower(), "surname")
                if kind == "surname":
                    surnames.add(w[0])
                elif kind.startswith("given_") and kind[6] != gender:
                    other = kind.replace("given_m", "given_f") if gender == "f" else kind.replace("given_f", "given_m")
                    kind = other if w[0].lower() in _LISTS[other] else kind
                found.append((kind, m.start() + w.start(), m.start() + w.end(), w[0]))
    held = {a for _, a, _, _ in found}
    for m in pairs:
        small = m[2].lower()
        if m.start(1) not in held and m.start(2) not in held and (small == m[2] or not re.search(rf"(?<!\w){re.escape(small)}(?!\w)", text)):
            found.append((_GIVEN[m[1].lower()], m.start(1), m.end(1), m[1]))
            kind = _GIVEN.get(m[2].lower(), "surname")
            found.append((kind, m.start(2), m.end(2), m[2]))
            if kind == "surname":
                surnames.add(m[2])
    if surnames:
        taken = {(a, b) for _, a, b, _ in found}
        for m in re.finditer(r"(?<!\w)(?:%s)(?!\w)" % "|".join(map(re.escape, sorted(surnames, key=len, reverse=True))), text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                found.append(("surname", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: x[1])


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[str, int, int, str]]]:
    """``text`` with its entities replaced, and ``(kind, start, stop, surrogate)`` in the new text."""
    out, made, at, length = [], [], 0, 0
    for kind, start, stop, value in detect(text):
        new = surrogate(key, kind, value, attempts.get((kind, value), 0))
        out += [text[at:start], new]
        length += start - at
        made.append((kind, length, length + len(new), new))
        length += len(new)
        at = stop
    return ("".join([*out, text[at:]]) if made else text), made


# --- tables ------------------------------------------------------------------------------------------


MENTIONS = "text_key binary, kind string, value string, surrogate string"
#: Parts into which the rows of one text, and the mentions of one entity, are dealt.
PARTS = 8


def _text_key(text) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _mentions(docs: DataFrame, key: bytes) -> DataFrame:
    """Each entity of each text once, with its first surrogate; ``text_key`` is the MD5 of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(_text_key(t), k, v, surrogate(key, k, v)) for t in frame["text"] if t is not None for k, v in {(k, v) for k, _, _, v in detect(t)}]
            yield pd.DataFrame(rows, columns=["text_key", "kind", "value", "surrogate"])

    return docs.select("text").mapInPandas(run, MENTIONS)


def exceptions(mentions: DataFrame, scratch: Scratch, key: bytes) -> DataFrame:
    """``kind, value, attempt`` of the entities of ``mentions`` whose first surrogate is an entity of some document,
    themselves included, or that of another entity.

    They are drawn again until none is left; a format whose values are all taken raises an error after ``MOST_DRAWS`` draws.
    """
    entities = scratch.keep(mentions.select("kind", "value", "surrogate").distinct(), "entities")
    real = entities.select(F.col("value").alias("taken")).distinct()

    def again(attempt: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame["surrogate"] = [surrogate(key, k, v, attempt) for k, v in zip(frame["kind"], frame["value"])]
                yield frame[["kind", "value", "surrogate"]].assign(attempt=attempt)

        return run

    settled = entities.withColumn("attempt", F.lit(0))
    schema = "kind string, value string, surrogate string, attempt int"
    for attempt in range(1, MOST_DRAWS + 2):
        # of several that share a surrogate the least keeps it
        first = settled.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("keeps"))
        clash = settled.join(real, F.col("surrogate") == F.col("taken"), "left_semi").select("kind", "value")
        shared = settled.join(first, "surrogate").filter(F.struct("attempt", "kind", "value") != F.col("keeps")).select("kind", "value")
        bad = scratch.keep(clash.unionAll(shared).distinct(), "clash")
        if not bad.limit(1).count():
            return settled.filter("attempt > 0").select("kind", "value", "attempt")
        if attempt > MOST_DRAWS:
            kinds = sorted(r["kind"] for r in bad.select("kind").distinct().collect())
            raise ValueError(f"no values are left for surrogates of {', '.join(kinds)}")
        settled = scratch.keep(settled.join(bad, ["kind", "value"], "left_anti").unionAll(bad.mapInPandas(again(attempt), schema).select(*settled.columns)), "settled")
    raise AssertionError


#: Bits of the filter of texts with entities that were drawn again, as a table of at most 2**18 words.
FILTER_BITS = 24


def _flagged(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``rows`` with ``flag``: whether their text may be one of ``own`` (text_key), by a filter of bits that is broadcast as
    words of 64 bits, 4 MB at most. Only flagged texts are shuffled; where most are in ``own``, most are."""
    def place(hexadecimal) -> Column:
        return F.conv(F.substring(hexadecimal, 1, FILTER_BITS // 4), 16, 10).cast("long")

    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = own.select(place(F.hex("text_key")).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    met = rows.withColumn("place", place(F.md5("text"))).join(F.broadcast(bits), F.shiftright("place", 6) == F.col("word"), "left")
    return met.withColumn("flag", F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False))).select(*rows.columns, "flag")


def pseudonymise(docs: DataFrame, scratch: Scratch, key: bytes) -> DataFrame:
    """``doc_id, text, n_entities, entities`` for each row of ``docs`` (doc_id, text), whole texts, entities replaced.

    ``entities`` holds kind, place and surrogate in the new text. Null texts stay null without entities;
    a text of any length is searched as a whole; rows of one text are treated alike, whatever their ids, null ones too; other columns are left alone; an empty
    table gives an empty result. What was drawn again reaches a text by a join on the text's MD5.
    """
    mentions = scratch.keep(_mentions(docs, key), "mentions")
    drawn = scratch.keep(exceptions(mentions, scratch, key), "exceptions")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    # an entity, or a text, may hold many of the rows: both are dealt in parts
    part = F.pmod(F.xxhash64("text_key"), F.lit(PARTS)).cast("int")
    own = mentions.select("text_key", "kind", "value", part.alias("part")).distinct().join(drawn.withColumn("part", parts), ["kind", "value", "part"])
    own = own.groupBy("text_key").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("own")).withColumn("part", parts)
    own = scratch.keep(own, "own")
    rows = _flagged(docs.select("doc_id", "text"), own)
    none = F.lit(None).cast(own.schema["own"].dataType)
    some = rows.filter("flag").withColumn("part", (F.monotonically_increasing_id() % PARTS).cast("int"))
    some = some.join(own, (F.unhex(F.md5("text")) == F.col("text_key")) & (some["part"] == own["part"]), "left").select("doc_id", "text", "own")
    rows = rows.filter("not flag").select("doc_id", "text", none.alias("own")).unionAll(some)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for text, own in zip(frame["text"], frame["own"]):
                attempts = {(o["kind"], o["value"]): o["attempt"] for o in own} if own is not None else {}
                made.append(replace(text, key, attempts) if text is not None else (None, []))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "text": [t for t, _ in made],
                    "n_entities": [len(e) for _, e in made],
                    "entities": [[dict(zip(("kind", "start", "stop", "surrogate"), x)) for x in e] for _, e in made],
                }
            )

    schema = "doc_id long, text string, n_entities int, entities array<struct<kind:string,start:int,stop:int,surrogate:string>>"
    return map_rows(rows, run, schema)
