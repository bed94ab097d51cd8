"""Replacement of personal data by keyed surrogates.

Detected entities (e-mail addresses, phone, card, account and identity numbers, network addresses, names after a title or a
cue, or with a known given name in any case and with or without accents) get replacements of the same type and format. Each replacement is a keyed
permutation of the entity's own domain: digits stay digits, letters keep case, script and vowel or consonant,
card and account numbers keep their check digits' validity, given names stay among names of their gender. What is permuted is the entity itself and
not its spelling, so a phone number or an address gets the same surrogate in every format. A
permutation never maps two entities to one, and the offset inside it never maps an entity to itself, so
distinctness and coreference hold over all documents without any shared table. Where two domains
meet (names in and outside the known lists) the permutation is walked until its output is back in its own
domain. ``checked`` runs the collision check over a whole written result, by hashes of entities and of what stands for them, and takes another key on a hit.

Defined results: a null text stays null with no entities; an empty one stays empty. Repeated rows change alike. Very long texts and entities are read whole. Letters
of scripts without a table keep their place. Case does not distinguish names or addresses. Other columns are never read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.text import columns, map_arrow
from strataloom.plans.workspace import Workspace

KEY = "strataloom"

# Given names by gender, titles by gender, and letters by class.
FEMALE = "anna maria mary linda susan karen lisa nancy helen sandra donna carol ruth sharon laura sarah jessica emma olivia sophia julia claire marie sophie camille elena lucia carmen ana isabel sabine petra ursula monika heike ingrid eva clara nina paula".split()
MALE = "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george kevin brian edward peter hans klaus jürgen stefan pierre jean luc michel antoine juan carlos jose luis miguel pablo diego otto karl".split()
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr"), "": ("Dr", "Prof")}
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "áàâäéèêëíìîïóòôöúùûü", "çñß",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
#: Code points of letters of further scripts, each range a class: Devanagari, Hebrew, Arabic, kana, Han, Hangul.
RANGES = ((0x0905, 0x0939), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
CLASSES += tuple("".join(map(chr, range(a, b + 1))) for a, b in RANGES)
_CLASS = {c: (k, i) for k, cs in enumerate(CLASSES) for i, c in enumerate(cs)}

_NUMBER = re.compile(r"(?<![\w.])\+?\(?\d[\d ().-]{5,}\d(?![\w])")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_SIX = re.compile(r"(?<![\w:.])(?=[\da-fA-F:]*:[\da-fA-F]*:)[\da-fA-F:]{2,39}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?!\w)")
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = rf"(?!(?:{_TITLE})\b)[^\W\d_a-zà-öø-ÿ][^\W\d_]+"
_TITLED = re.compile(rf"\b({_TITLE})" + r"\.?[ ]+(" + _NAME + r"(?:[ ]" + _NAME + r"){0,2})")
_WORD = re.compile(r"[^\W\d_]+")
_CUED = re.compile(r"\b(?:[Mm]y name is|[Nn]amed|[Nn]ame:|[Dd]ear|[Ss]igned(?: by)?|[Rr]egards,|[Cc]ontact:?|[Aa]uthor:?)\s+(" + _NAME + r"(?:[ ]" + _NAME + r"){1,2})")


def plain(name: str) -> str:
    """Lower case without accents, as known names are looked up."""
    return "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))


_KNOWN = {plain(name): (pool, k) for pool in (FEMALE, MALE) for k, name in enumerate(pool)}


def permute(value: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size) without fixed points: a Feistel network walked within the range, and an offset between its two passes."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d" % (r, size, x), key=key, digest_size=(half + 7) // 8).digest(), "big") & mask

    def walk(x: int, rounds: range) -> int:
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                a, b = (b, a ^ f(r, b)) if rounds.step > 0 else (b ^ f(r, a), a)
            x = a << half | b
            if x < size:
                return x

    offset = 1 + int.from_bytes(hashlib.blake2b(b"offset|%d" % size, key=key, digest_size=16).digest(), "big") % (size - 1)
    return walk((walk(value, range(6)) + offset) % size, range(5, -1, -1))


def _key(key: str, *kind: str) -> bytes:
    return hashlib.blake2b("|".join(kind).encode(), key=key.encode()[:64], digest_size=32).digest()


def letters(text: str, key: str, kind: str) -> str:
    """Permute the characters that have a class, all others fixed; the pattern of classes and case stays."""
    folded = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [(i, *_CLASS[c]) for i, c in enumerate(folded) if c in _CLASS]
    value, size = 0, 1
    for _, k, place in at:
        value, size = value * len(CLASSES[k]) + place, size * len(CLASSES[k])
    pattern = "".join(chr(65 + _CLASS[c][0]) if c in _CLASS else c for c in folded)
    value, out = permute(value, size, _key(key, kind, pattern)), folded[:]
    for i, k, _ in reversed(at):
        value, place = divmod(value, len(CLASSES[k]))
        out[i] = CLASSES[k][place]
    return "".join(o.upper() if len(o.upper()) == 1 and t != f else o for o, t, f in zip(out, text, folded))


def _digits(text: str, key: str, kind: str, keep: int = 0) -> str:
    """Permute the digits after the first ``keep``; punctuation stays."""
    places = [i for i, c in enumerate(text) if c.isdigit()]
    kept, places = "".join(text[i] for i in places[:keep]), places[keep:]
    if not places:
        return text
    n = len(places)
    new = str(permute(int("".join(text[i] for i in places)), 10**n, _key(key, kind, str(n), kept))).zfill(n)
    out = list(text)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


def _phone(text: str, key: str) -> str:
    """The last ten digits at most; what stands before them is the country's."""
    return _digits(text, key, "phone", 0) if (n := sum(map(str.isdigit, text))) <= 10 else text[: (at := _place(text, n - 10))] + _digits(text[at:], key, "phone")


def _place(text: str, digits: int) -> int:
    """Where the text goes on after so many digits."""
    for i, c in enumerate(text):
        if c.isdigit():
            if not digits:
                return i
            digits -= 1
    return len(text)


def _iban(text: str, key: str) -> str:
    """The account within its country's format, with check digits that hold."""
    packed = text.replace(" ", "")
    account = letters(packed[4:], key, f"iban{packed[:2]}")
    check = 98 - _mod97(account + packed[:2] + "00")
    new = iter(f"{packed[:2]}{check:02d}{account}")
    return "".join(" " if c == " " else next(new) for c in text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _six(text: str, key: str) -> str:
    """Another address of the same network prefix of 16 bits, written out if the original is."""
    value = int(ipaddress.IPv6Address(text))
    new = ipaddress.IPv6Address(value >> 112 << 112 | permute(value & (1 << 112) - 1, 1 << 112, _key(key, "six")))
    out = new.compressed if "::" in text else new.exploded if len(text) == 39 else ":".join(f"{int(x, 16):x}" for x in new.exploded.split(":"))
    return out.upper() if text.upper() == text else out


def luhn(payload: str) -> int:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return -total % 10


def _card(text: str, key: str) -> str:
    places = [i for i, c in enumerate(text) if c.isdigit()]
    number = "".join(text[i] for i in places)
    off = (int(number[-1]) - luhn(number[:-1])) % 10
    payload = _digits(number[:-1], key, f"card{len(number)}.{off}", 1)
    out = list(text)
    for i, c in zip(places, payload + str((luhn(payload) + off) % 10)):
        out[i] = c
    return "".join(out)


def _address(text: str, key: str) -> str:
    value = 0
    for part in text.split("."):
        value = value << 8 | int(part)
    value = permute(value, 1 << 32, _key(key, "ip"))
    padded = [len(p) if p[0] == "0" and len(p) > 1 else 0 for p in text.split(".")]
    return ".".join(str(value >> s & 255).zfill(n) for s, n in zip((24, 16, 8, 0), padded))


def _case_like(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new


def person_name(name: str, key: str) -> str:
    """A known given name becomes another of its gender; other names are permuted by letters, outside the known ones."""
    if (known := _KNOWN.get(plain(name))) is not None:
        pool, at = known
        return _case_like(pool[permute(at, len(pool), _key(key, "given", pool[0]))], name)
    new = letters(name, key, "name")
    while plain(new) in _KNOWN:
        new = letters(new, key, "name")
    return new


def canonical(kind: str, text: str) -> str:
    """What an entity is, whatever its format."""
    if kind in ("phone", "card", "ssn"):
        return "".join(filter(str.isdigit, text))[-10 if kind == "phone" else 0 :]
    if kind == "ip":
        return ".".join(str(int(p)) for p in text.split("."))
    if kind == "six":
        return ipaddress.IPv6Address(text).compressed
    if kind == "iban":
        return text.replace(" ", "")
    return plain(text) if kind in ("given", "surname") and plain(text) in _KNOWN else text.lower()


def surrogate(kind: str, text: str, key: str = KEY) -> str:
    if kind == "email":
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{letters(local, key, 'local')}@{letters(host, key, 'host')}.{top}"
    if kind == "ip":
        return _address(text, key)
    if kind == "card":
        return _card(text, key)
    if kind in ("phone", "iban", "six"):
        return {"phone": _phone, "iban": _iban, "six": _six}[kind](text, key)
    if kind == "ssn":
        return _digits(text, key, "ssn")
    return person_name(text, key)


def _number_kind(found: str) -> str | None:
    digits = sum(c.isdigit() for c in found)
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", found):
        return "ip" if all(int(p) < 256 for p in found.split(".")) else None
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", found):
        return "ssn"
    if 13 <= digits <= 19 and re.fullmatch(r"\d+(?:[ -]\d+)*", found):
        return "card"
    if 7 <= digits <= 15 and (found[0] in "+(" or re.fullmatch(r"\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}", found)):
        return "phone"
    return None


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NUMBER.finditer(text):
        if kind := _number_kind(m[0]):
            yield m.start(), m.end(), kind
        elif " " in m[0]:  # several numbers in a row
            for part in re.finditer(r"[^ ]+", m[0]):
                if kind := _number_kind(part[0]):
                    yield m.start() + part.start(), m.start() + part.end(), kind


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind), in order and not overlapping."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = at, _DOMAIN.match(text, at + 1)
        while left and (text[left - 1].isalnum() or text[left - 1] in "_.+-"):  # never over another @
            left -= 1
        if left < at and right:
            found.append((left, right.end(), "email"))
        at = text.find("@", at + 1)
    found += _numbers(text)
    for m in _IBAN.finditer(text):
        packed = m[0].replace(" ", "")
        if _mod97(packed[4:] + packed[:4]) == 1:
            found.append((m.start(), m.end(), "iban"))
    for m in _SIX.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        found.append((m.start(), m.end(), "six"))
    names: list[tuple[int, int, str]] = []
    for pattern, group in ((_TITLED, 2), (_CUED, 1)):
        for m in pattern.finditer(text):
            names += _parts(m.start(group), m[group])
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    for (a, b, given), (c, d, last) in zip(words, words[1:]):
        if c == b + 1 and text[b] == " " and plain(given) in _KNOWN and len(last) > 1 and _goes_with(given, last):
            names += [(a, b, "given"), (c, d, "surname")]
    surnames = {text[a:b] for a, b, kind in names if kind == "surname"}
    if surnames:  # later mentions without a title
        names += [(a, b, "surname") for a, b, word in words if word in surnames]
    found += names
    out: list[tuple[int, int, str]] = []
    for span in sorted(set(found), key=lambda s: (s[0], -s[1], s[2])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _goes_with(given: str, last: str) -> bool:
    """Whether a known given name and the word after it are written like a name: both with a capital, or both without and the name no common word."""
    if given[0].isupper():
        return last[0].isupper() and last not in _TITLES
    return last[0].islower() and plain(given) not in COMMON and last not in COMMON and len(last) > 3


# Given names that are words too, and words that often follow a name and are none.
COMMON = frozenset("mark carol grace eva ana jean luc juan and or the is was has had who that with from said says will would can could should must may might also then when where were does did".split())
_TITLES = frozenset(t for ts in TITLES.values() for t in ts)


def _parts(start: int, names: str) -> Iterator[tuple[int, int, str]]:
    parts = names.split(" ")
    for k, part in enumerate(parts):
        yield start, start + len(part), "given" if k < len(parts) - 1 else "surname"
        start += len(part) + 1


def rewrite(text: str | None, key: str = KEY) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) of each entity in the original."""
    if not text:
        return text, []
    out, at, spans = [], 0, []
    for start, end, kind in detect(text):
        new = surrogate(kind, text[start:end], key)
        out += [text[at:start], new]
        spans.append((start, end, kind, new))
        at = end
    return "".join(out) + text[at:], spans


_ENTITY = "struct<start: long, end: long, kind: string, surrogate: string, entity: long, stand_in: long>"


def _hash(kind: str, text: str, key: bytes) -> int:
    kind = "name" if kind in ("given", "surname") else kind
    return int.from_bytes(hashlib.blake2b(f"{kind}|{canonical(kind if kind != 'name' else 'surname', text)}".encode(), key=key, digest_size=8).digest(), "big", signed=True)


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per document: id, text with surrogates, entities (start, end, kind, surrogate, and keyed hashes of the entity and of its stand-in)."""
    import pyarrow as pa

    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    names = ("start", "end", "kind", "surrogate", "entity", "stand_in")
    span = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("entities", pa.list_(span))])

    def run(batches):
        secret = _key(key, "entity")
        for batch in batches:
            out, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = rewrite(text, key)
                out.append(new)
                spans.append([dict(zip(names, (*s, _hash(s[2], text[s[0] : s[1]], secret), _hash(s[2], s[3], secret)))) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(spans, schema.field("entities").type)], schema=schema)

    return map_arrow(texts, run, f"id long, text string, entities array<{_ENTITY}>")


def collisions(result: DataFrame) -> DataFrame:
    """(kind, value, what): stand-ins of more than one entity, and entities with more than one stand-in; empty if all is well.

    The least and the greatest of a group differ if any do, so an entity in very many rows is combined before the shuffle.
    """
    kind = F.when(F.col("e.kind").isin("given", "surname"), "name").otherwise(F.col("e.kind")).alias("kind")
    spans = result.select(F.explode("entities").alias("e")).select(kind, "e.entity", "e.stand_in")
    found = []
    for by, of in (("stand_in", "entity"), ("entity", "stand_in")):
        groups = spans.groupBy("kind", F.col(by).alias("value")).agg(F.min(of).alias("least"), F.max(of).alias("greatest"))
        found.append(groups.where("least <> greatest").select("kind", "value", F.lit(by).alias("what")))
    return found[0].unionByName(found[1])


def checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, keys: int = 3) -> DataFrame:
    """``pseudonymize``, written and checked; on a collision another key derived from the first is taken, ``keys`` times in all."""
    work = Workspace(docs.sparkSession, "pii")
    for k in range(keys):
        result = work.table(pseudonymize(docs, id_col, text_col, f"{key}#{k}" if k else key), f"result-{k}")
        if collisions(result).isEmpty():
            return result
        work.drop(f"result-{k}")
    raise ValueError(f"collisions with {keys} keys")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listing = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "text", F.size("entities").cast("long").alias("n_entities"), listing.alias("spans"))
