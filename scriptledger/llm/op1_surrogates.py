"""Surrogates for personal data and secrets: keyed, type-consistent, distinct.

Detected entities have a kind and a canonical value (digits of a phone number,
lower-cased address, one part of a person's name). A keyed hash of kind, value
and attempt drives a generator that keeps the kind's shape: letters stay letters,
digits digits, a valid check sum valid, a name's script and gender. An occurrence
is written in its own format (separators, case). So one value has one surrogate
wherever it stands, in all texts and all runs with one key.

Distinct values must get distinct surrogates, none of which is itself a detected
value: the corpus's distinct values are checked in a distributed table; of those
that collide one keeps its surrogate and the others take the next attempt, until
none collides. From attempt ``LIKE`` on a surrogate is a little longer each time (an
IPv4 address has parts beyond 255), so every shape has room. Attempt 0 is recomputed where the texts are; only values with a
later attempt are passed to them.

Names are found after a title or as a listed given name before another name word;
within a text, later mentions of either part alone are found from there, written as
found, capitalised or in capitals. Not found: names that a text only has without a
title and with an unlisted given name, mentions in other texts alone, in lower case,
inflected or as nicknames; unquoted secrets without a digit; postal addresses, dates
of birth and user names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import durable

#: Values on a later attempt, up to which they are broadcast; beyond they are joined.
BROADCAST_VALUES = 100_000
#: Attempts that keep a value's length.
LIKE = 4
#: Letters and digits of a secret that drawing by shape must change; with fewer, all characters are drawn.
LEAST_DRAWN = 6

# Titles and given names by gender, as written in texts.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Don", "Sr", "Г-н", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Sra", "Srta", "Г-жа", "Госпожа", "Κυρία")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Mx")
MALE_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Karl Jürgen "
    "Klaus Wolfgang Stefan Pierre Jacques Jean Michel Philippe François José Juan Carlos Luis Miguel Javier "
    "Иван Сергей Алексей Дмитрий Николай Γιώργος Νίκος"
).split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Anna Laura Julia Petra Ursula "
    "Monika Sabine Heike Claire Camille Nathalie Isabelle Céline María Carmen Lucía Isabel Pilar Elena "
    "Мария Анна Елена Ольга Наталья Ελένη Μαρία"
).split()

#: Columns beside the caller's while attempts are joined.
ROW_KEY, ATTEMPTS = "__surrogate_row", "__surrogate_attempts"

NAME_WORD = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]*(?:[-'’][^\W\d_]+)?"


def holds(*literals: str):
    return lambda text: any(literal in text for literal in literals)


def holds_word(least: int):
    return lambda text: max(map(len, text.split()), default=0) >= least


#: Kind, pattern and what every text with a match satisfies, which is found much faster; None: a digit.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), holds("@")),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S), holds("-----BEGIN ")),
    ("secret", re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,})(?![\w-])"), holds("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"), holds_word(32)),
    ("secret", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*(?:[\"']([^\s\"']{6,})[\"']|((?=[^\s\"',;&<>()\[\]{}]*\d)[^\s\"',;&<>()\[\]{}]{6,})(?<![.:])(?![\w(\[]))"), holds("=", ":")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), None),
    ("mac", re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])"), None),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){0,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"), holds(":")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"), None),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), None),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"), None),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?!\w|\.\d)"), None),
    ("phone", re.compile(r"(?<![\w.])\+\d{8,15}(?!\d)"), None),
]
PART = re.compile(r"[^\W\d_]+")
WHOLE_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")
KEY_PARTS = re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)(.*?)(-----END [A-Z ]*PRIVATE KEY-----)", re.S)
KEY_BREAK = re.compile(r"(\\[nr]|\s+)")
NUMERIC = re.compile(r"[0-9]")
DATE = re.compile(r"(?:\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{4})$")
TITLED = re.compile(rf"(?<!\w)({'|'.join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)})\.? ({NAME_WORD})(?: ({NAME_WORD}))?")
NAMED = re.compile(rf"(?<!\w)({'|'.join(MALE_NAMES + FEMALE_NAMES)})(?: ({NAME_WORD}))(?!\w)")
GENDER = dict.fromkeys(MALE_TITLES, "m") | dict.fromkeys(FEMALE_TITLES, "f") | dict.fromkeys(NEUTRAL_TITLES, "n")
GIVEN = dict.fromkeys(map(str.lower, MALE_NAMES), "m") | dict.fromkeys(map(str.lower, FEMALE_NAMES), "f")


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), in order, without overlap; earlier patterns win."""
    found: list[tuple[int, int, str, str]] = []
    numeric = NUMERIC.search(text) is not None
    for kind, pattern, may_match in PATTERNS:
        if not (may_match(text) if may_match else numeric):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 0)
            value = text[start:end]
            canonical = canonical_value(kind, value)
            if canonical is not None:
                found.append((start, end, kind, canonical))
    for m in TITLED.finditer(text):
        gender, first, last = GENDER[m[1]], m[2], m[3]
        if last:
            found.append((*m.span(2), f"given-{GIVEN.get(first.lower(), gender)}-{script_of(first)}", first.lower()))
            found.append((*m.span(3), f"family-{script_of(last)}", last.lower()))
        else:
            found.append((*m.span(2), f"family-{script_of(first)}", first.lower()))
    for m in NAMED.finditer(text):
        found.append((*m.span(1), f"given-{GIVEN[m[1].lower()]}-{script_of(m[1])}", m[1].lower()))
        found.append((*m.span(2), f"family-{script_of(m[2])}", m[2].lower()))
    kept, taken = [], bytearray(len(text))

    def keep(some) -> None:
        for one in some:  # earlier ones win
            if taken.find(1, one[0], one[1]) < 0:
                kept.append(one)
                taken[one[0] : one[1]] = b"\x01" * (one[1] - one[0])

    keep(found)
    # Later or earlier mentions of a name alone.
    forms: dict[str, tuple[str, str]] = {}
    for start, end, kind, value in sorted(kept):
        if kind.startswith(("given", "family")):
            for form in (text[start:end], value.capitalize(), value.upper()):
                if len(form) > 1:
                    forms.setdefault(form, (kind, value))
    if forms:
        mentions = []
        for m in WHOLE_WORD.finditer(text):
            # A compound as it is, else its parts.
            for part in [m] if m[0] in forms else PART.finditer(text, *m.span()):
                if part[0] in forms:
                    mentions.append((*part.span(), *forms[part[0]]))
        keep(mentions)
    return sorted(kept)


def canonical_value(kind: str, value: str) -> str | None:
    if kind == "email":
        return value.lower()
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 else None
    if kind == "ipv6":
        # Words with colons are not addresses: two groups, five digits, one of them decimal.
        if len(re.findall("[0-9A-Fa-f]+", value)) < 2 or sum(c.isalnum() for c in value) < 5 or not NUMERIC.search(value):
            return None
        try:
            return ipaddress.IPv6Address(value).exploded
        except ValueError:
            return None
    if kind == "iban":
        compact = value.replace(" ", "")
        return compact if 15 <= len(compact) <= 34 and iban_rest(compact) == 1 else None
    if kind == "mac":
        return re.sub("[:-]", "", value).lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        marks = len(re.findall(r"[ .-]", value))
        if not 7 <= len(digits) <= 15 or DATE.match(value) or not ("+" in value or "(" in value or marks >= 2):
            return None
        return ("+" if "+" in value else "") + digits
    return value


class Source:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n = key, "\x1f".join(what).encode(), 0
        self.pool = b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.what + self.n.to_bytes(4, "big"), key=self.key).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32


LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def drawn(characters: str, n: int, draw: Source) -> str:
    return "".join(characters[draw.below(len(characters))] for _ in range(n))


def secret_shape(value: str, draw: Source) -> str:
    """By shape, but every character drawn where a shape would hardly change it."""
    if sum(c.isdigit() or c.isalpha() for c in value) < LEAST_DRAWN:
        return drawn(LETTERS + DIGITS, max(len(value), LEAST_DRAWN), draw)
    return same_shape(value, draw)


def same_shape(value: str, draw: Source, keep: int = 0) -> str:
    """Letters of the same case and digits for each, other characters as they are."""
    out = [value[:keep]]
    for i, c in enumerate(value[keep:]):
        if c.isdigit():
            out.append("0123456789"[draw.below(10)] if i or keep or c == "0" else "123456789"[draw.below(9)])
        elif c.isalpha():
            letter = chr(97 + draw.below(26))
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


#: Consonants and vowels of made-up names by script, and endings by gender (family names: "n").
SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": ("n", "r", "s", "k"), "f": ("a", "ia"), "n": ("en", "is", "ov")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("н", "р", "с"), "f": ("а", "ия"), "n": ("ко", "ин", "ов")}),
    "greek": ("βγδζκλμνπρστ", "αειο", {"m": ("ος", "ης"), "f": ("α", "η"), "n": ("ου", "ης", "ας")}),
}


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical surrogate of a canonical value."""
    draw = Source(key, kind, value, str(attempt))
    more = max(0, attempt - LIKE + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        # One domain, one surrogate domain; its last label stays.
        labels = domain.split(".")
        host = Source(key, "domain", domain)
        local = same_shape(local, draw) + drawn(LETTERS, more, draw)
        return f"{local}@{'.'.join(same_shape(x, host) for x in labels[:-1])}.{labels[-1]}"
    if kind == "ip":
        return ".".join(str(256 + draw.below(744) if more else 1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        return ":".join(drawn(HEX, 4, draw) for _ in range(8 + more))
    if kind == "mac":
        return drawn(HEX, len(value) + more, draw)
    if kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        return drawn(HEX if value == value.lower() else HEX.upper(), len(value) + more, draw)
    if kind == "secret":
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|eyJ|", value)[0]
        return head + secret_shape(value[len(head) :], draw) + drawn(LETTERS, more, draw)
    if kind == "private_key":
        first, body, last = KEY_PARTS.fullmatch(value).groups()
        # Line breaks stay, also those written as escapes.
        parts = KEY_BREAK.split(body)
        if sum(c.isalnum() for x in parts[::2] for c in x) < LEAST_DRAWN:
            parts = [*parts, drawn(LETTERS + DIGITS, 64, draw)]
        new = "".join(x if i % 2 else same_shape(x, draw) for i, x in enumerate(parts))
        return first + new + drawn(LETTERS, more, draw) + last
    if kind == "card":
        # First digit (the network) stays; valid numbers stay valid, others invalid.
        body = value[0] + drawn(DIGITS, len(value) - 2 + more, draw)
        right = next(d for d in DIGITS if luhn_sum(body + d) == 0)
        return body + (right if luhn_sum(value) == 0 else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        country, rest = value[:2], same_shape(value[4:], draw) + drawn(DIGITS, more, draw)
        return f"{country}{98 - iban_rest(country + '00' + rest):02d}{rest}"
    if kind == "phone":
        keep = 2 if value.startswith("+") else 0  # the plus and the first digit of the country's code
        return value[:keep] + same_shape(value[keep:], draw) + drawn(DIGITS, more, draw)
    if kind == "ssn":
        return same_shape(value, draw) + drawn(DIGITS, more, draw)
    part, *_, script = kind.split("-")
    consonants, vowels, ends = SOUNDS[script]
    gender = kind.split("-")[1] if part == "given" else "n"
    # Later attempts have more syllables, hence more room.
    count = 2 + (part == "family") + attempt // 4 + more
    name = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(count))
    end = ends[gender][draw.below(len(ends[gender]))]
    return (name[:-1] if end[0] in vowels else name) + end


def written(kind: str, original: str, new: str) -> str:
    """The canonical surrogate in the format of an occurrence."""
    if kind.startswith(("given", "family")):
        return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()
    if kind in ("card", "ssn", "phone", "iban", "mac"):
        it = iter(new.lstrip("+"))
        out = "".join(next(it, "") if c.isalnum() else c for c in original) + "".join(it)
        return out.upper() if kind == "mac" and original.upper() == original else out
    if kind == "ipv6":
        return new.upper() if original.upper() == original and original.lower() != original else new
    if kind == "email":
        # Case by place on either side of the sign; what is longer stays lower case.
        pairs = zip(original.split("@"), new.split("@"), strict=True)
        return "@".join("".join(n.upper() if o.isupper() else n for o, n in zip_longest(old[: len(x)], x, fillvalue="")) for old, x in pairs)
    return new


def entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (kind, value) per batch."""
    for batch in batches:
        found = {(kind, value) for text in batch.column("text").to_pylist() if text for _, _, kind, value in find_entities(text)}
        kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row's key, kind, value) of every row."""
    for batch in batches:
        out = [(key, kind, value) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for kind, value in {x[2:] for x in find_entities(text)}]
        keys, kinds, values = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["key", "kind", "value"])


def candidates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield batch.append_column("new", pa.array([surrogate(key, *row) for row in rows], pa.string()))

    return run


def settled_attempts(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the values whose first surrogate collided."""
    schema = "kind string, value string, attempt int, new string"
    state = durable(values.withColumn("attempt", F.lit(0)).mapInArrow(candidates(key), schema), "op1-values")
    later = None
    while True:  # ends: later surrogates are ever longer
        # One value of each surrogate keeps it: the one with the earliest attempt. None keeps a detected value.
        keeper = state.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("keeper")).where("n > 1")
        shared = state.join(keeper, ["kind", "new"]).where(F.col("value") != F.col("keeper.value")).select("kind", "value")
        real = state.join(values.select("kind", F.col("value").alias("new")), ["kind", "new"]).select("kind", "value")
        losers = durable(shared.unionAll(real).distinct(), "op1-losers")
        if losers.isEmpty():
            return later if later is not None else state.where("false").select("kind", "value", "attempt")
        moved = state.join(losers, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        state = durable(
            state.join(losers, ["kind", "value"], "left_anti").unionAll(moved.mapInArrow(candidates(key), schema)), "op1-values"
        )
        later = state.where("attempt > 0").select("kind", "value", "attempt")


def replaced(key: bytes, sent, columns: list[str]):
    """Texts with surrogates; attempts come from a broadcast map, or with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent is not None else {}
        for batch in batches:
            own = batch.column(ATTEMPTS).to_pylist() if sent is None else [None] * batch.num_rows
            texts, found = [], []
            for text, mine in zip(batch.column("text").to_pylist(), own, strict=True):
                entities = find_entities(text) if text else []
                if not entities:
                    texts.append(text)
                    found.append([])
                    continue
                attempts = {(x["kind"], x["value"]): x["attempt"] for x in mine} if mine else known
                out, at = [], 0
                for start, end, kind, value in entities:
                    new = surrogate(key, kind, value, attempts.get((kind, value), 0))
                    out += [text[at:start], written(kind, text[start:end], new)]
                    at = end
                texts.append("".join(out) + text[at:])
                found.append([x[2] for x in entities])
            arrays = {c: batch.column(c) for c in columns}
            arrays |= {"text": pa.array(texts, pa.string()), "entities": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(arrays)

    return run


def replace_personal_data(docs: DataFrame, key: bytes, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """``docs`` with personal data and secrets in text replaced, and entities, the kinds
    found in order.

    ``docs`` needs text; all other columns are kept (one named entities is
    replaced). A null text stays null, an empty one empty, both without entities;
    a text without any stays as it is. Repeated rows and equal texts get equal
    results. An empty table gives an empty result. ``key``: up to 64 secret bytes;
    another key gives other surrogates.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "entities"]
    read = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema) + ", entities array<string>"
    values = durable(read.select("text").mapInArrow(entity_rows, "kind string, value string").distinct(), "op1-entities")
    later = settled_attempts(values, key)
    count = later.limit(broadcast_values + 1).count()
    if count <= broadcast_values:
        known = {(r["kind"], r["value"]): r["attempt"] for r in later.collect()}
        return read.mapInArrow(replaced(key, spark.sparkContext.broadcast(known), columns), schema)
    keyed = read.withColumn(ROW_KEY, F.xxhash64("text"))
    attempts = (
        keyed.select(F.col(ROW_KEY).alias("key"), "text")
        .mapInArrow(document_rows, "key long, kind string, value string")
        .distinct()
        .join(later, ["kind", "value"])
        .groupBy(F.col("key").alias(ROW_KEY))
        .agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(ATTEMPTS))
    )
    return keyed.join(durable(attempts, "op1-attempts"), ROW_KEY, "left").drop(ROW_KEY).mapInArrow(replaced(key, None, columns), schema)


#: Key of the registered query; a real run passes its own secret.
QUERY_KEY = b"registered query"


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    found = replace_personal_data(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.concat_ws(",", "entities").alias("kinds"))
