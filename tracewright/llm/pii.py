"""Surrogates for personal data: keyed, type-consistent replacements of the same format.

Numbers, addresses and secrets go through a keyed permutation of their own format (a Feistel network over the integers
that the format can write), so two of them never meet and the same one is always replaced alike. A person is given names
and a family name; each part has a surrogate of its own, of its gender and script, so a person keeps one name whatever
the title and whether the whole name or a part of it is written. Surrogates of names come from small pools first, then
from syllables, more of them with every attempt, so their space cannot run out. Collision checks run over all distinct
entities of the corpus: one whose replacement is another's replacement, or is itself an entity of the corpus, moves on to
its next replacement until none collides.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import stage

#: Moved entities that may be broadcast; beyond, they are joined to their documents.
MOST_MOVED = 200_000

_KEYS = r"(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
# Titles by gender; given names by script and gender and family names by script; words that introduce a
# name; capitalised words that follow names without being part of them.
_TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña госпожа".split(),
    "n": "Dr Prof Professor".split(),
}
GIVEN = {
    ("latin", "m"): "James Robert John Michael David William Thomas Charles Daniel Matthew Paul Mark Peter Karl Hans Jean Pierre Luis Carlos Diego".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Emma Laura Julia Marie Claire Sophie Carmen Lucia Ingrid Greta".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Иван Николай Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
}
FAMILY = {
    "latin": "Smith Johnson Brown Taylor Miller Wilson Moore Clark Lewis Walker Hall Young King Wright Hill Green Baker Carter Weber Fischer Wagner Becker Martin Bernard Dubois Moreau Garcia Lopez Perez Torres".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов".split(),
}
_CUES = ("my name is", "mein name ist", "je m'appelle", "me llamo", "name:", "signed by", "sincerely,", "regards,")
_NOT_NAMES = frozenset("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())

_TITLE = "|".join(sorted((t for x in _TITLES.values() for t in x), key=len, reverse=True))
_KNOWN = "|".join(sorted((n for x in GIVEN.values() for n in x), key=len, reverse=True))
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zà-öø-ÿа-яё"
_NAME = rf"(?:[OD]['’])?[{_UP}][{_LOW}]+(?:['’-]?[{_UP}][{_LOW}]+)*"
_BLANK = r"[^\S\n]+"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERN = re.compile(
    rf"(?P<email>[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{{2,}})"
    r"|(?P<secret>(?i:(?<![^\W_])(?:[a-z0-9]+[_-])*(?:(?:password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?key)\s*[=:]|(?:token|secret)\s*(?:=|:(?=\s*[\"']?\S*\d))))"
    rf"\s*[\"']?(?P<value>[\w+/=.-]{{6,}})[\"']?|\b(?:{_KEYS})|\b(?=[a-fA-F]*\d)[0-9a-fA-F]{{32,64}}\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<mac>\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b)"
    rf"|(?P<ipv6>(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:]))"
    r"|(?P<ssn>(?<![\d-])(?!000|666|9)\d{3}(?P<gap>[- ])(?!00)\d{2}(?P=gap)(?!0000)\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8})(?!\d))"
)
_KINDS = ("email", "secret", "ip", "mac", "ipv6", "ssn", "card", "iban", "phone")
PERSON = re.compile(
    rf"\b(?P<title>{_TITLE})\.?\s+(?:(?:{_TITLE})\.?\s+)*(?P<titled>{_NAME}(?:{_BLANK}{_NAME}){{0,2}})"
    rf"|\b(?P<known>(?:{_KNOWN})(?:-{_NAME})?(?:{_BLANK}{_NAME}){{1,2}})"
    rf"|(?i:\b(?:{'|'.join(c.replace(' ', '[ ]+') for c in _CUES)}))\s+(?P<told>{_NAME}(?:{_BLANK}{_NAME}){{1,2}})"
)
_DIGIT = re.compile(r"\d")


@cache
def _triggers() -> ahocorasick.Automaton:
    """Lower-cased words without which no name, and without a digit or @ no secret, is found."""
    found = ahocorasick.Automaton()
    names = [w.lower() for x in (*_TITLES.values(), *GIVEN.values()) for w in x]
    for w in (*(f"{n}{c}" for n in names for c in " .-\t\xa0\n"), *(c.split()[0] for c in _CUES)):
        found.add_word(w, 1)
    for w in ("token", "secret", "passw", "passphrase", "pwd", *(f"{a}{s}key" for a in ("api", "access", "secret", "private", "auth") for s in ("", "_", "-")), "akia", "eyj", *(f"xox{c}-" for c in "abprs"), *(f"gh{c}_" for c in "pousr"), *(f"{c}k{s}" for c in "spr" for s in "-_")):
        found.add_word(w, 2)
    found.make_automaton()
    return found


def _may_hold(text: str) -> tuple[bool, bool]:
    """Whether a text may hold numbers, addresses or secrets, and whether it may hold names; far cheaper than the patterns."""
    seen = {kind for _, kind in _triggers().iter(text.lower())}
    return 2 in seen or "@" in text or _DIGIT.search(text) is not None or "::" in text, 1 in seen


# ---------------------------------------------------------------------------------------------------------------------
# Replacements
# ---------------------------------------------------------------------------------------------------------------------
def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it falls inside."""
    if size <= 1:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    nbytes = (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for k in range(8):
            d = hashlib.blake2b(right.to_bytes(nbytes, "big"), key=key, person=hashlib.blake2s(f"{tweak}|{k}".encode(), digest_size=16).digest(), digest_size=min(64, nbytes + 8))
            left, right = right, left ^ (int.from_bytes(d.digest(), "big") & mask)
        x = left << half | right
        if x < size:
            return x


def _alphabet(c: str, hexadecimal: bool) -> str:
    """The characters that may stand where c stands; c alone for a separator or a script without an alphabet here."""
    if hexadecimal:
        return "0123456789abcdef" if c in "0123456789abcdef" else "0123456789ABCDEF" if c in "0123456789ABCDEF" else c
    if c.isdigit() and c.isascii():
        return "0123456789"
    for low in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àâäçèéêëîïñóôöùúûüßáí"):
        if c in low:
            return low
        if c in (up := low.upper().replace("SS", "")):
            return up
    return c


def _permuted(key: bytes, kind: str, s: str, hexadecimal: bool = False) -> str:
    alphabets = [_alphabet(c, hexadecimal) for c in s]
    # the format is part of the tweak: entities of one format are permuted among themselves
    size, x = 1, 0
    for c, a in zip(s, alphabets, strict=True):
        size, x = size * len(a), x * len(a) + a.index(c)
    y = permute(key, kind + "|" + "|".join(a if len(a) == 1 else str(len(a)) + a[0] for a in alphabets), x, size)
    out = []
    for a in reversed(alphabets):
        y, k = divmod(y, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return (10 - total % 10) % 10


def is_card(digits: str) -> bool:
    """13 to 19 digits whose last is the check digit of the others."""
    return 13 <= len(digits) <= 19 and _luhn(digits[:-1]) == int(digits[-1])


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity have in common."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention)
    if kind == "ipv6":
        return ipaddress.IPv6Address(mention).exploded
    if kind in ("email", "mac"):
        return mention.lower().replace("-", ":") if kind == "mac" else mention.lower()
    if kind == "iban":
        return mention.replace(" ", "")
    return " ".join(mention.split())


def script(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", name) else "latin"


def usual_gender(given: str) -> str:
    """m or f by the name alone: that of the pool that holds it, else by its last letter."""
    first = given.split("-")[0]
    for (_, gender), names in GIVEN.items():
        if first in names:
            return gender
    return "f" if given[-1] in "aeiаяеи" else "m"


def _syllables(script_: str, d: int, count: int) -> str:
    """A name of `count` syllables written by the digits of d."""
    consonants, vowels, ends = ("bdfghjklmnprstvw", "aeiou", "nrslmtk") if script_ == "latin" else ("бвгдзклмнпрстхчш", "аеиоу", "нрслмтк")
    out = ""
    for _ in range(count):
        d, c = divmod(d, len(consonants))
        d, v = divmod(d, len(vowels))
        out += consonants[c] + vowels[v]
    return (out + ends[d % len(ends)]).capitalize()


def replace(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str | None = None) -> str:
    """The replacement of a canonical entity; attempt > 0 after collisions. gender (m, f): of a given name, if not its usual one."""
    salted = kind if not attempt else f"{kind}#{attempt}"
    if kind in ("given", "family"):
        of = script(entity)
        d = int.from_bytes(hashlib.blake2b(f"{salted}|{entity}".encode(), key=key, digest_size=32).digest(), "big")
        sex = (gender or usual_gender(entity)) if kind == "given" else ""
        pool = GIVEN[of, sex] if kind == "given" else FAMILY[of]
        if not attempt:
            return pool[d % len(pool)]
        made = _syllables(of, d, attempt + 1)  # each collision adds a syllable, so the space grows 80 times
        return made + ("a" if of == "latin" else "а") if sex == "f" else made
    if kind == "card":
        if is_card(entity):
            body = _permuted(key, salted + "luhn", entity[:-1])
            return body + str(_luhn(body))
        return _permuted(key, salted, entity)
    if kind == "phone" and entity.startswith("+"):
        country = 2 if entity.startswith(("+1", "+7")) else 3
        return entity[:country] + _permuted(key, salted, entity[country:])
    if kind == "ip":
        octets = [int(p) for p in entity.split(".")]
        if max(octets) > 255:
            return ".".join(_permuted(key, salted, p) for p in entity.split("."))
        y = permute(key, salted, int.from_bytes(bytes(octets), "big"), 1 << 32)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "ipv6":  # groups that are zero stay so, the others never become zero: the short form keeps its shape
        groups = [int(g, 16) for g in entity.split(":")]
        filled = [i for i, g in enumerate(groups) if g]
        x = 0
        for i in filled:
            x = x * 65535 + groups[i] - 1
        y = permute(key, f"{salted}|{filled}", x, 65535 ** len(filled))
        for i in reversed(filled):
            y, g = divmod(y, 65535)
            groups[i] = g + 1
        return ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups)).exploded
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_permuted(key, salted, local)}@{_permuted(key, salted + 'host', host)}.{top}"
    if kind == "iban":
        return entity[:2] + _permuted(key, salted, entity[2:])
    return _permuted(key, salted, entity, hexadecimal=kind in ("secret", "mac") and bool(re.fullmatch(r"[0-9a-f:]+|[0-9A-F:]+", entity)))


def render(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the mention's own writing: its separators and its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(re.sub(r"[^0-9A-Za-z]", "", replacement))
        return "".join(next(signs, "") if c.isalnum() else c for c in mention)
    if kind == "mac":
        return (replacement.upper() if mention.upper() == mention else replacement).replace(":", mention[2])
    if kind == "ipv6":
        short = ipaddress.IPv6Address(replacement).compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in replacement.split(":"))
        return short.upper() if mention.upper() == mention and mention.lower() != mention else short
    if mention.isupper():
        return replacement.upper()
    if kind == "email":
        return "".join(r.upper() if m.isupper() else r for m, r in zip(mention, replacement, strict=True)) if len(mention) == len(replacement) else replacement
    return replacement


# ---------------------------------------------------------------------------------------------------------------------
# Detection
# ---------------------------------------------------------------------------------------------------------------------
def _valid(kind: str, mention: str) -> bool:
    if kind == "card":
        return is_card(re.sub(r"\D", "", mention))
    if kind == "ipv6":
        try:
            groups = ipaddress.IPv6Address(mention).exploded.split(":")
        except ValueError:
            return False
        return sum(int(g, 16) > 0 for g in groups) >= 3 and any(c.isdigit() for c in mention)
    return True


def _parts(name: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, given or family, part) of a name; what follows a weekday or month is no name."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", name)]
    stop = next((i for i, w in enumerate(words) if w[2] in _NOT_NAMES), len(words))
    words = words[:stop]
    if len(words) == 1:
        lone = "given" if any(words[0][2] in names for names in GIVEN.values()) else "family"
        return [(*words[0][:2], lone, words[0][2])]
    return [(b, e, "given" if i < len(words) - 1 else "family", w) for i, (b, e, w) in enumerate(words)]


def entities(text: str | None) -> Iterator[tuple[int, int, int, str, str, int]]:
    """(mention, begin, end, kind, canonical entity, evidence) in order: spans of one mention of a person share its number.

    evidence: 1 for a given name after a man's title, -1 after a woman's, else 0. A person is found by a title, by a
    known given name before another name, or by words that introduce one; then other mentions in the text of the same
    names are that person's.
    """
    if not text:
        return
    signs, names = _may_hold(text)
    spans: list[tuple[int, int, int, str, str, int]] = []
    n = 0
    for m in PATTERN.finditer(text) if signs else ():
        kind = next(k for k in _KINDS if m[k] is not None)
        if not _valid(kind, m[0]):
            continue
        whole = "value" if kind == "secret" and m["value"] is not None else kind
        spans.append((n, m.start(whole), m.end(whole), kind, canonical(kind, m[whole]), 0))
        n += 1
    if names:
        taken = [(b, e) for _, b, e, *_ in spans]
        found: dict[str, str] = {}
        for m in PERSON.finditer(text):
            group = next(g for g in ("titled", "known", "told") if m[g] is not None)
            parts = _parts(m[group])
            at = m.start(group)
            if not parts or group != "titled" and len(parts) < 2 or any(b < at + parts[-1][1] and at + parts[0][0] < e for b, e in taken):
                continue
            sex = 1 if m["title"] in _TITLES["m"] else -1 if m["title"] in _TITLES["f"] else 0
            for b, e, kind, part in parts:
                spans.append((n, at + b, at + e, kind, part, sex if kind == "given" else 0))
                taken.append((at + b, at + e))
                found.setdefault(part, kind)
            n += 1
        if found:
            plain = set(re.findall(rf"(?<![^\W\d_])[{_LOW}]+(?![^\W\d_])", text))
            again = [p for p, kind in found.items() if p.lower() not in plain]  # a word that is also written small is no sure name
            if again:
                taken_at = {b for b, _ in taken}
                for m in re.finditer(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(again, key=len, reverse=True)))})(?![\w-])", text):
                    if m.start() not in taken_at and not any(b <= m.start() < e for b, e in taken):
                        spans.append((n, m.start(), m.end(), found[m[0]], m[0], 0))
                        n += 1
    yield from sorted(spans, key=lambda s: s[1])


def rewrite(text: str, key: bytes, moved: dict[tuple[str, str], tuple[int, str | None]]) -> tuple[str, int, list[str]]:
    """The text with its entities replaced, the number of mentions and their kinds."""
    out, at, mentions, kinds = [], 0, set(), set()
    for n, lo, hi, kind, entity, _ in entities(text):
        out += [text[at:lo], render(kind, text[lo:hi], replace(key, kind, entity, *moved.get((kind, entity), (0, None))))]
        at = hi
        mentions.add(n)
        kinds.add("person" if kind in ("given", "family") else kind)
    return "".join([*out, text[at:]]), len(mentions), sorted(kinds)


# ---------------------------------------------------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------------------------------------------------
def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got: dict[tuple[str, str], int] = {}
        for t in b.column(0):
            for _, _, _, kind, entity, evidence in entities(t.as_py()):
                got[kind, entity] = got.get((kind, entity), 0) + evidence
        cols = [pa.array([k for k, _ in got], pa.string()), pa.array([e for _, e in got], pa.string()), pa.array(got.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "entity", "evidence"])


def _replaced(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, found, genders, attempts = (b.column(i).to_pylist() for i in range(4))
            out = [replace(key, k, e, a, g) for k, e, g, a in zip(kinds, found, genders, attempts, strict=True)]
            fixed = [k not in ("given", "family") and all(len(_alphabet(c, False)) == 1 for c in e) for k, e in zip(kinds, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(fixed, pa.bool_())], names=["kind", "entity", "gender", "attempt", "new", "fixed"])

    return run


def _deviating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gender that titles tell of a given name, where it is not the usual one; else null."""
    for b in batches:
        kinds, found, evidence = (b.column(i).to_pylist() for i in range(3))
        told = ["m" if v > 0 else "f" if v < 0 else None for v in evidence]
        out = [g if k == "given" and g and g != usual_gender(e) else None for k, e, g in zip(kinds, found, told, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["kind", "entity", "gender"])


def moved_entities(docs: DataFrame, key: bytes, rounds: int = 200) -> DataFrame:
    """(kind, entity, attempt, gender) for the entities that a plain replacement does not serve; raises if a format has no room.

    Those whose first replacement collides, and given names that the corpus' titles show to be of the other gender than
    the usual one. Entities without any character that has an alphabet here stay as they are and are not judged. Only
    what still collides goes into the next round.
    """
    found = docs.select(F.col("text").cast("string")).mapInArrow(_found, "kind string, entity string, evidence long")
    found = found.groupBy("kind", "entity").agg(F.sum("evidence").alias("evidence"))
    found = stage(found.mapInArrow(_deviating, "kind string, entity string, gender string"), "entities")
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("space")
    real = found.select(space, F.col("entity").alias("new")).distinct().withColumn("real", F.lit(True))
    state, settled = found.withColumn("attempt", F.lit(0)), None
    for _ in range(rounds):
        new = stage(state.mapInArrow(_replaced(key), "kind string, entity string, gender string, attempt int, new string, fixed boolean"), "replaced")
        # of contestants the least entity takes a replacement; none may name a real entity, or one that is taken already
        owner = new.groupBy("kind", "new").agg(F.min("entity").alias("owner"))
        judged = new.join(owner, ["kind", "new"]).withColumn("space", space).join(real, ["space", "new"], "left")
        bad = (F.col("owner") != F.col("entity")) | F.coalesce("real", F.lit(False))
        if settled is not None:
            judged = judged.join(settled.select("kind", "new", F.lit(True).alias("taken")), ["kind", "new"], "left")
            bad |= F.coalesce("taken", F.lit(False))
        judged = stage(judged.select("kind", "entity", "gender", "attempt", "new", (~F.col("fixed") & bad).alias("clash")), "judged")
        good = judged.where("not clash").select("kind", "entity", "gender", "attempt", "new")
        settled = good if settled is None else settled.unionAll(good)
        state = judged.where("clash").select("kind", "entity", "gender", (F.col("attempt") + 1).cast("int").alias("attempt"))
        if state.isEmpty():
            return settled.where("attempt > 0 or gender is not null").select("kind", "entity", "attempt", "gender")
    kinds = [r["kind"] for r in state.select("kind").distinct().orderBy("kind").collect()]
    raise RuntimeError(f"replacements still collide after {rounds} rounds: {', '.join(kinds)}")


def _rewritten(key: bytes, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value if shared is not None else {}
        for b in batches:
            own = b.column(2).to_pylist() if shared is None else [None] * len(b)
            out = []
            for t, o in zip(b.column(1), own, strict=True):
                moved = everywhere if shared is not None else {(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in o or ()}
                out.append(rewrite(t.as_py() or "", key, moved))
            cols = [b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_entities", "kinds"])

    return run


def surrogates(docs: DataFrame, key: str, most_moved: int = MOST_MOVED) -> DataFrame:
    """doc_id, text (entities replaced), n_entities (mentions), kinds: one row per row. One entity is replaced alike in all documents.

    Defined cases: a null text is empty; a text without entities comes back as it is; repeated rows are each rewritten
    alike; a null doc_id stays null; other columns are not read. Entities in scripts without an alphabet here keep those
    characters. Scale: entities are collapsed on the map side; the few that collide are broadcast up to `most_moved` and
    beyond that joined to the documents that hold them. Texts are otherwise not shuffled.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    secret = hashlib.sha256(key.encode()).digest()
    moved = moved_entities(d, secret)
    schema = "doc_id long, text string, n_entities long, kinds array<string>"
    if (n := moved.limit(most_moved + 1).count()) <= most_moved:
        table = {(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in moved.collect()} if n else {}
        return d.mapInArrow(_rewritten(secret, spark.sparkContext.broadcast(table)), schema)
    mark = F.xxhash64("doc_id", "text")
    d = d.withColumn("mark", mark)
    holds = d.select("mark", "text").mapInArrow(_holding, "mark long, kind string, entity string").distinct()
    own = holds.join(moved, ["kind", "entity"]).groupBy("mark").agg(F.collect_set(F.struct("kind", "entity", "attempt", "gender")).alias("moved"))
    return d.join(own, "mark", "left").select("doc_id", "text", "moved").mapInArrow(_rewritten(secret, None), schema)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(m, kind, entity) for m, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for _, _, _, kind, entity, _ in entities(t.as_py())]
        cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["mark", "kind", "entity"])
