"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score.

Base kinds are email, ip, card (Luhn) and phone; they stay whatever their score. Three kinds are added where their score reaches LEAST:
account numbers (IBAN) whose remainder by 97 is one, and, as no checksum can tell them from other digits, national insurance
numbers and phone numbers without a country code, which need a word nearby that says what they are. An added span that overlaps
a base span or an earlier added kind is left out, but for account numbers, which their checksum proves.

A score is what the form alone is worth (PRIOR), plus NEAR for a word of the kind among the words just before or
after the span, less NEAR for a word that speaks against it; from 0 to 1.

Every expression is anchored so that a text takes time in proportion to its length, whatever it holds.

Defined results: a null or empty text has no span; a very long text is searched whole; repeated rows get equal results;
offsets are code points, ends exclusive; spans of one start stand in the order of KINDS; a null id stays null; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import batch_of, struct, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "insurance", "local")
BASE = 4
PRIOR = (0.9, 0.6, 0.8, 0.7, 0.9, 0.3, 0.3)
NEAR, LEAST = 0.3, 0.6
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# no match can begin inside a run of digits that none began at, and a match takes the whole of its last run
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
INSURANCE = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL = re.compile(r"(?<![\w+.(-])\(?[0-9]{3,5}\)?[ /.-]{1,2}[0-9](?:[ .-]?[0-9]){4,10}(?![\w-])")

# Fixed values of ISO 13616: characters of an account number by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}

#: Words that speak for a kind, in the languages of the corpus.
FOR = {
    "email": "email mail contact kontakt correo courriel write schreiben contacto contacter",
    "ip": "ip address host server client login adresse dirección",
    "card": "card visa mastercard credit karte kreditkarte carte tarjeta payment",
    "phone": "phone tel telephone call mobile fax telefon handy anruf téléphone teléfono móvil",
    "iban": "iban account bank konto compte cuenta transfer",
    "insurance": "ssn social security insurance",
    "local": "phone tel telephone call mobile fax telefon handy anruf téléphone teléfono móvil",
}
#: Words that speak against every kind.
AGAINST = frozenset("version release isbn order invoice serial example sample test beispiel exemple ejemplo rechnung".split())
FOR = [frozenset(FOR[k].split()) for k in KINDS]
#: Words that stand alone, not parts of an address.
WORD = re.compile(r"(?<![\w@.-])[^\W\d_]+(?![\w@]|\.\w)")


def luhn(digits: str) -> bool:
    """Every second digit from the right counts double, with its digits added; the sum ends in 0."""
    total = sum(map(int, digits[::-1][::2]))
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[::-1][1::2])) % 10 == 0


def mod_97(account: str) -> bool:
    """The first four characters go to the end, letters count 10 to 35; the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


@cache
def account_of(length: int) -> re.Pattern:
    """What follows a country's first four characters."""
    return re.compile(rf"(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @: the name is the run of its characters before it, from the end of the last match on."""
    done = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        least = max(done, text.rfind("@", done, at) + 1)
        start = least + len(text[least:at].rstrip(LOCAL_PART))
        if start < at:
            done = m.end()
            yield start, done


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(part := p.lstrip("0")) < 4 and int(part or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return found


def proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the added kinds, confirmed where a checksum can."""
    for m in IBAN.finditer(text):
        if (length := IBAN_LENGTH.get(m[1])) and (rest := account_of(length).match(text, m.end())) and mod_97(text[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), 4, rest.end()
    if "-" in text:
        yield from ((m.start(), 5, m.end()) for m in INSURANCE.finditer(text))
    for m in LOCAL.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 13:
            yield m.start(), 6, m.end()


def score(text: str, kind: int, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start]) + WORD.findall(text[end : end + AFTER])}
    return min(1.0, max(0.0, PRIOR[kind] + NEAR * bool(near & FOR[kind]) - NEAR * bool(near & AGAINST)))


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of what is kept, in order."""
    found = [(*s, score(text, s[1], s[0], s[2])) for s in base(text)]
    taken = [(a, b) for a, _, b, _ in found]
    for a, kind, b in proposed(text):
        if kind != 4 and any(x < b and a < y for x, y in taken):
            continue
        worth = score(text, kind, a, b)
        if worth >= LEAST:
            found.append((a, kind, b, worth))
            taken.append((a, b))
    return sorted(found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_email, n_ip, n_card, n_phone, n_added and found (start, kind, stop and score, in order)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    schema = struct(("id", source.schema["id"].dataType), ("found", T.ArrayType(struct(("start", "int"), ("kind", "int"), ("stop", "int"), ("score", "double")))))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("start", "kind", "stop", "score"), s)) for s in spans(t.as_py())] for t in batch.column(1)]
            yield batch_of({"id": batch.column(0), "found": found}, schema)

    rows = source.mapInArrow(run, schema)
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: count(lambda f: f["kind"] == k)
    return rows.select(
        F.col("id").alias(id_col), *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        count(lambda f: f["kind"] >= BASE).alias("n_added"), "found",
    )


def written(found: Column, scores: bool = False) -> Column:
    """kind:start:end, joined by commas; with scores also these, with two digits."""
    kinds = F.array(*map(F.lit, KINDS))
    part = lambda f: [F.get(kinds, f["kind"]), f["start"].cast("string"), f["stop"].cast("string"), *[F.format_number(f["score"], 2)] * scores]
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", *part(f))), ",")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with every span of at least that score replaced by its kind in brackets; all rows and columns, a null text stays null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def replaced(text: str | None) -> str | None:
        parts, end = [], 0
        for a, kind, b, worth in spans(text or ""):
            if worth >= least:
                if a >= end:
                    parts += [text[end:a], f"[{KINDS[kind].upper()}]"]
                end = max(end, b)
        return None if text is None else "".join([*parts, text[end:]])

    def run(batches):
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(schema)}
            yield batch_of(columns | {text_col: [replaced(t.as_py()) for t in batch.column(at)]}, schema)

    return docs.mapInArrow(run, schema)
