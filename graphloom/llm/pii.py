"""Personal data: detection, and keyed surrogates of the same type and format.

Kinds: email, phone, card, ssn, iban, ipv4, ipv6, secret (keys, tokens and
passwords), name (a title or a known first name, and a surname).

A surrogate is the image of the entity's *canonical form* (digits of a number, a
mail address without regard to case, the number that an IP address stands for) under
a keyed permutation of all forms of its own format: letters become letters of the
same script, digits digits; punctuation, spacing and case are put back as they were.
The permutation is a Feistel network over the format's mixed radix numbers,
conjugated with a shift by one, so that it has no fixed point; a step that leaves the
format's rules is repeated until it returns to them (cycle walking, which keeps it
one to one and always ends).  So equal entities get equal surrogates in every
document and however they are written (coreference), different ones get different
surrogates (distinctness), no table is kept and nothing travels between machines.
Who has the key can undo it: there is no default key.  First names are permuted
within the listed names of their own gender and script, other names letter by letter
with vowels and consonants in place; mail hosts are permuted apart from the local
part, so colleagues stay colleagues; cards keep whether their check digit is right,
IBANs whether their check digits are, IPv4 and IPv6 addresses stay addresses, with
leading zeros, case and compression as they were.

Names are found after a title, from a listed first name, or after a phrase that
announces one ("my name is", "signed by", "Author:"); what a document calls a person
once is replaced wherever it stands alone in the same document.  Names that nothing
announces stay.

:func:`entity_collisions` counts, over the whole corpus, surrogates that stand for two
entities: none may; :func:`pseudonymise_checked` refuses a result that has any.

All patterns take time in proportion to the text: keywords and "@" are found first and
looked around within fixed distances.

Defined cases: null texts stay null and empty ones empty, without entities; where
two kinds match, the one that starts first and then the longer wins; very long texts
are searched whole; mail local parts of over 64 and secrets of over 4096 characters
are no such entities; repeated rows are treated alike; null ids are ids like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

#: Titles and first names, by gender and script.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"), "": ("Dr", "Prof", "Professor")}
FIRST_NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Karl Jürgen Wolfgang Klaus Stefan Pierre Jean Jacques Louis Michel François Carlos José Luis Miguel Javier Antonio".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Ursula Monika Petra Sabine Heike Ingrid Marie Nathalie Isabelle Sylvie Françoise Camille Carmen María Ana Isabel Lucía Pilar".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία".split(),
}
_NAMED = {n: k for k, names in FIRST_NAMES.items() for n in names}
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_SPOKEN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *_ALPHABETS[3:]]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]

#: Phrases that announce a name.
_CUE = r"(?:my name is|je m'appelle|me llamo|ich hei(?:ß|ss)e|signed by|written by|yours sincerely,|kind regards,|(?:author|contact|name|from|signed)\s{0,3}:)\s{1,3}"
_TITLE = "|".join(sorted({regex.escape(t) for g in TITLES.values() for t in g}, key=len, reverse=True))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_LOCAL_END = set("._%+'-")
_HOST = regex.compile(r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])")
_NUMBER = regex.compile(
    r"(?<![\w.])(?:(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|-\d)"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{7,15})(?![\w]))"
    r"|(?<![\w+])(?P<plus>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4})(?![\w])"
    r"|(?<!\w)(?P<paren>\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4})(?![\w])"
)
_DATE = regex.compile(r"(?:19|20)\d\d[ .-]\d{1,2}[ .-]\d{1,2}|\d{1,2}[ .-]\d{1,2}[ .-](?:19|20)\d\d")
_IBAN = regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_IPV6 = regex.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_SECRET = regex.compile(
    r"""(?i:(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\w-]{0,64}+["']?\s{0,8}+[:=]\s{0,8}+)(?:"(?P<a>[^"\s]{6,4096}+)"|'(?P<b>[^'\s]{6,4096}+)'|(?P<c>[^\s"',;]{8,4096}+))"""
    r"|(?<!\w)(?P<d>(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,4096}+|[0-9a-f]{32,4096}+|[0-9A-F]{32,4096}+)(?!\w)|(?<![\w-])(?:sk-[A-Za-z0-9_-]{16,4096}+|xox[abprs]-[A-Za-z0-9-]{10,4096}+)(?!\w)|(?<![\w-])eyJ[\w-]{8,4096}+\.[\w-]{8,4096}+\.[\w-]{4,4096}+)"
)
_WORD = r"\p{Lu}[\p{Ll}'’-]{1,40}+"
_NAME = regex.compile(
    rf"\b(?:(?P<title>{_TITLE})\.? (?P<first>{_WORD})(?: (?P<last>{_WORD}))?"
    rf"|(?P<given>{'|'.join(sorted(map(regex.escape, _NAMED), key=len, reverse=True))}) (?P<family>{_WORD})"
    rf"|(?i:{_CUE})(?P<cued>{_WORD}) (?P<after>{_WORD}))(?!\w)"
)
_ALONE = regex.compile(rf"(?<!\w){_WORD}(?!\w)")


def _round(key: bytes, label: str, i: int, half: int, bits: int) -> int:
    size = (bits + 7) // 8
    digest = hashlib.blake2b(half.to_bytes(size, "big") + bytes([i]) + label.encode(), key=key[:64], digest_size=min(64, size)).digest()
    while len(digest) < size:
        digest += hashlib.blake2b(digest + bytes([i]), key=key[:64], digest_size=64).digest()
    return int.from_bytes(digest[:size], "big") & ((1 << bits) - 1)


def permute(x: int, modulus: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(modulus) without fixed points (modulus > 1)."""
    bits = max(1, (max(modulus - 1, 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1

    def feistel(v: int, order) -> int:
        while True:
            a, b = v >> bits, v & mask
            if order is _FORWARD:
                for i in order:
                    a, b = b, a ^ _round(key, label, i, b, bits)
            else:
                for i in order:
                    a, b = b ^ _round(key, label, i, a, bits), a
            v = a << bits | b
            if v < modulus:
                return v

    return feistel((feistel(x, _FORWARD) + 1) % modulus, _BACKWARD)


_FORWARD, _BACKWARD = tuple(range(8)), tuple(reversed(range(8)))


def permute_text(text: str, key: bytes, label: str, alphabets: list[str] = _ALPHABETS, good: Callable[[str], bool] = lambda s: True) -> str:
    """The image of `text` among the texts of its format for which `good` is as it is for `text`.

    Walks the permutation's cycle until it meets such a text: at the latest, where it began.
    """
    places = [next((a for a in alphabets if c in a), c) for c in text]
    modulus = 1
    for p in places:
        modulus *= len(p)
    if modulus < 2:
        return text
    now = 0
    for c, p in zip(text, places, strict=True):
        now = now * len(p) + p.index(c)
    format_ = label + "|" + "".join(p if len(p) == 1 else chr(0xE000 + alphabets.index(p)) for p in places)
    wanted = good(text)
    while True:
        now = rest = permute(now, modulus, key, format_)
        out = []
        for p in reversed(places):
            rest, digit = divmod(rest, len(p))
            out.append(p[digit])
        if good(found := "".join(reversed(out))) == wanted:
            return found


def digits_only(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _spread(text: str, characters: str, replaced: Callable[[str], bool]) -> str:
    """`text` with `characters` in the places of those that are to be replaced."""
    given = iter(characters)
    return "".join(next(given) if replaced(c) else c for c in text)


def _as_cased(like: str, text: str) -> str:
    """`text` in the case of `like`, letter by letter, where that is reversible."""
    return "".join(u if c.isupper() and len(u := t.upper()) == 1 else t for c, t in zip(like, text, strict=True))


def fold_case(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(value: str, key: bytes) -> str:
    """Keeps the country and how far the check digits are from the right ones (0: they are right)."""
    plain = "".join(value.split())
    country, check, rest = plain[:2], int(plain[2:4]), plain[4:]
    found = permute_text(rest, key, "iban" + country)
    off = (check - _iban_check(country, rest)) % 100
    return _spread(value, f"{country}{(_iban_check(country, found) + off) % 100:02d}{found}", lambda c: c != " ")


def _ipv4(value: str, key: bytes) -> str:
    parts = value.split(".")
    number = permute(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, key, "ipv4")
    width = 3 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    return ".".join(f"{number >> 8 * (3 - i) & 255:0{width}d}" for i in range(4))


def _ipv6(value: str, key: bytes) -> str:
    address = IPv6Address(permute(int(IPv6Address(value)), 1 << 128, key, "ipv6"))
    out = address.compressed if "::" in value else address.exploded if regex.search(r"(?<![0-9A-Fa-f])0[0-9A-Fa-f]", value) else ":".join(f"{int(x, 16):x}" for x in address.exploded.split(":"))
    return out.upper() if any(c.isupper() for c in value) else out


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def canonical(kind: str, value: str) -> str:
    """What all ways of writing an entity have in common."""
    if kind == "email":
        return fold_case(value)
    if kind in ("card", "ssn"):
        return digits_only(value)
    if kind == "phone":
        return f"{len(_country(value))}:{digits_only(value)}"
    if kind == "ipv4":
        return ".".join(str(int(p)) for p in value.split("."))
    if kind == "ipv6":
        return IPv6Address(value).compressed
    return "".join(value.split()) if kind == "iban" else value


def _country(value: str) -> str:
    head = regex.match(r"\+\d{1,3}(?=[ .(-])", value)
    return head[0] if head else ""


@lru_cache(200_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    digit = "0123456789".__contains__
    if kind == "email":
        local, _, host = value.rpartition("@")
        name, _, top = host.rpartition(".")
        return _as_cased(local, permute_text(fold_case(local), key, "local")) + "@" + permute_text(fold_case(name), key, "host") + "." + top
    if kind in ("card", "ssn"):
        return _spread(value, permute_text(digits_only(value), key, kind, good=luhn if kind == "card" else lambda s: s[0] != "0"), digit)
    if kind == "phone":
        head = _country(value)
        rest = value[len(head) :]
        return head + _spread(rest, permute_text(digits_only(rest), key, kind, good=lambda s: s[0] != "0"), digit)
    if kind == "ipv4":
        return _ipv4(value, key)
    if kind == "ipv6":
        return _ipv6(value, key)
    if kind == "secret":
        for alphabet in _HEX:
            if all(c in alphabet for c in value):
                return permute_text(value, key, "hex", [alphabet])
        return permute_text(value, key, kind)
    if kind == "iban":
        return _iban(value, key)
    if kind.startswith("first"):
        for (gender, script), names in FIRST_NAMES.items():
            if value in names and kind in ("first", "first" + gender):
                return names[permute(names.index(value), len(names), key, gender + script)]
        return permute_text(value, key, "first", _SPOKEN, good=lambda s: s in _NAMED)
    return permute_text(value, key, "surname", _SPOKEN)


def _mails(text: str) -> Iterator[tuple[int, int]]:
    at, until = text.find("@"), 0
    while at >= 0:
        start = at
        while start > max(until, at - 64) and ((c := text[start - 1]).isalnum() or c in _LOCAL_END):
            start -= 1
        cut = start > until and ((c := text[start - 1]).isalnum() or c in _LOCAL_END) and start == at - 64
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and not cut and (host := _HOST.match(text, at + 1)):
            yield start, host.end()
            until = host.end()
        at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """(start, end, kind, parts) in order; parts are the stretches to replace, each with its own kind."""
    found: list[tuple[int, int, str, list[tuple[int, int, str]]]] = []

    def add(start: int, end: int, kind: str) -> None:
        found.append((start, end, kind, [(start, end, kind)]))

    for start, end in _mails(text):
        add(start, end, "email")
    for m in _NUMBER.finditer(text):
        kind, value = m.lastgroup, m[0]
        digits = sum(map(str.isdigit, value))
        if kind == "ipv4":
            if any(int(p) > 255 for p in value.split(".")):
                continue
        elif kind == "card" and not 13 <= digits <= 19:
            continue
        elif kind in ("phone", "plus", "paren"):
            sure = "+" in value or "(" in value
            if not (7 if sure else 9) <= digits <= 15 or (not sure and _DATE.match(value)):
                continue
            kind = "phone"
        add(m.start(), m.end(), kind)
    for m in _SECRET.finditer(text):
        add(*m.span(m.lastgroup), "secret")
    for m in _IBAN.finditer(text):
        if sum(map(str.isdigit, m[0])) >= 8:
            add(m.start(), m.end(), "iban")
    if "::" in text or text.count(":") > 4:
        for m in _IPV6.finditer(text):
            try:
                IPv6Address(m[0])
            except AddressValueError:
                continue
            add(m.start(), m.end(), "ipv6")
    for m in _NAME.finditer(text):
        if m["title"]:
            gender = _GENDER[m["title"]]
            parts = [(*m.span("first"), "first" + gender if m["last"] else "surname")]
            if m["last"]:
                parts.append((*m.span("last"), "surname"))
        elif m["given"]:
            parts = [(*m.span("given"), "first"), (*m.span("family"), "surname")]
        else:
            parts = [(*m.span("cued"), "first"), (*m.span("after"), "surname")]
        found.append((parts[0][0] if m["cued"] else m.start(), m.end(), "name", parts))
    if found and (known := {text[a:b] for *_, parts in found for a, b, part in parts if part == "surname" and b - a > 2}):
        for m in _ALONE.finditer(text):  # a person once named, by surname alone
            if m[0] in known:
                found.append((m.start(), m.end(), "name", [(m.start(), m.end(), "surname")]))
    found.sort(key=lambda e: (e[0], -e[1]))
    kept, until = [], 0
    for e in found:
        if e[0] >= until:
            kept.append(e)
            until = e[1]
    return kept


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and each entity: kind, start, end in the old text, and surrogate."""
    out, at, entities = [], 0, []
    for start, end, kind, parts in detect(text):
        piece, inner = [], start
        for a, b, part in parts:
            piece += [text[inner:a], surrogate(part, text[a:b], key)]
            inner = b
        piece = "".join(piece) + text[inner:end]
        out += [text[at:start], piece]
        entities.append({"kind": kind, "start": start, "end": end, "surrogate": piece})
        at = end
    return "".join(out) + text[at:], entities


ENTITY = "struct<kind:string,start:long,end:long,surrogate:string>"
PART = "struct<kind:string,surrogate:string,original:string>"


def _seal(kind: str, value: str, key: bytes) -> str:
    """A keyed hash of an entity: tells entities apart without giving them away."""
    return hashlib.blake2b(canonical(kind, value).encode("utf-8", "replace"), key=key[:64], digest_size=16, person=kind[:16].encode()).hexdigest()


def _rows(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities, parts (what was replaced by what, sealed)."""
    if not key:
        raise ValueError("surrogates need a secret key")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))
    part = pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string()), ("original", pa.string())]))

    def sealed(text: str) -> list[dict]:
        distinct = {(k.rstrip("mf") if k.startswith("first") else k, text[a:b], surrogate(k, text[a:b], secret)) for *_, parts in detect(text) for a, b, k in parts}
        return [{"kind": k, "surrogate": canonical(k, s), "original": _seal(k, v, secret)} for k, v, s in sorted(distinct)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [replace(t, secret) if t else (t, []) for t in texts]
            parts = [sealed(t) if f[1] else [] for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[1] for f in found], entity), pa.array(parts, part)], ["doc_id", "text", "n_entities", "entities", "parts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_entities long, entities array<{ENTITY}>, parts array<{PART}>")


def _clashes(rows: DataFrame) -> DataFrame:
    pairs = rows.select(F.explode("parts").alias("p")).select("p.*").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("originals")).filter("originals > 1")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text with surrogates, n_entities, entities (no original values)."""
    return _rows(docs, key, id_col, text_col).drop("parts")


def pseudonymise_checked(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`pseudonymise`, but written first and checked: no surrogate may stand for two entities."""
    rows = materialize(_rows(docs, key, id_col, text_col), "pii")
    if bad := _clashes(rows).count():
        raise RuntimeError(f"{bad} surrogates stand for more than one entity")
    return rows.drop("parts")


def entity_collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """kind, surrogate (canonical), originals: surrogates that stand for more than one entity in the corpus."""
    return _clashes(_rows(docs.select(F.lit(0).alias("_n"), F.col(text_col).alias("_text")), key, "_n", "_text"))
