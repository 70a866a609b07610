"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type and format.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards (by check digit), IBANs (by check
digits), US social security numbers, secrets (access keys, passwords, tokens) and names: those behind a title, and every other
mention, with a capital, of a name that the same document has behind a title. A replacement keeps the shape of what it replaces:
digits stay digits, letters stay letters of their case and script, separators stay, check digits are right, an address stays in
the same kind of network. A first name keeps its gender, which is that of the list of first names, else what most titles in the
corpus tell of it. Where so many entities share a shape that replacements run out, later attempts are longer, or leave the kind
of network, and the last is a keyed number in brackets, so that there is always one left.

One entity has one replacement in the whole corpus (coreference), since it is derived from a secret key, the type and the
normalised entity. That two entities never share a replacement (distinctness), and that no replacement is itself an entity of
the corpus, is checked over all distinct entities: those that collide, except the smallest of them, are derived again with the
next attempt number, until nothing collides. The entities of a later attempt, or of a gender that titles tell, reach the
documents by broadcast if there are few, else by a join; texts are replaced in one map.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, in_small_batches, row_name

#: Up to this many entities of later attempts or told gender (about 100 bytes each) are sent to every executor.
BROADCAST_ROWS = 100_000
#: Attempts after which replacements are longer or leave the kind of network, and after which they keep no format but are 128 bits of
#: the keyed hash in brackets, so that even a shape with fewer values than entities ends.
WIDER, LAST = 2, 64

# Titles with the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "M.": "m", "Señor": "m", "Sr.": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra.": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
# First names by script and gender; n may be either.
FIRST_NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Niels Oscar Paul Robert Simon Tobias Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Карина Лидия Мария Нина Ольга Полина Раиса".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος Στέλιος".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
# Syllables of surrogate surnames by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бо ва ви га го да до за зи ка ко ла ли ма ми на но па по ра ро са со та то".split(),
    "greek": "βα γα γο δα δι κα κο λα λι μα μι να νο πα πο ρα ρο σα τα το".split(),
}
GENDER = {name.casefold(): gender for (_, gender), names in FIRST_NAMES.items() for name in names}
WORD = r"[^\W\d_][\w'’-]*"
NAME = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\.?[  ](?=(?P<name>{WORD}(?:[  ]{WORD}){{0,2}}))")
HOST = re.compile(r"@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}")
LOCAL = re.compile(r"[\w%+.-]")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
RUN, PARTS = re.compile(r"[\w'’-]+"), re.compile(r"\w+")
TITLE = re.compile(r"[MHSDLPГΚ][\w.]{0,12}[  ]\w")
DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"[+(]?\d[\d .()/-]*")
IPV4 = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4})(?![\w]|[.-]\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS = re.compile(r"(?<!\w)(?P<kind>AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-)(?P<value>[A-Za-z0-9-]{12,})")
ACCESS_KINDS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox")
ASSIGNED = re.compile(r"(?i)(?<!\w)(?:api[_-]?key|access[_-]?key|auth[_-]?token|password|passwd|pwd|secret|token)[ ]?[=:][ ]?(?P<quote>[\"']?)(?P<value>[^\s\"']{8,})(?P=quote)")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    text: str  # normalised, what coreference goes by
    gender: str = ""  # what the title tells of a first name


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = int(x) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def detect(text: str) -> list[Entity]:
    """Entities of a text in order, without overlaps; of two that overlap, the kind listed first in the module stays."""
    found: list[Entity] = []
    if "@" in text:
        found += _emails(text)
    if "=" in text or ":" in text:
        found += [Entity(*m.span("value"), "secret", m["value"]) for m in ASSIGNED.finditer(text)]
    if any(x in text for x in ACCESS_KINDS):
        found += [Entity(*m.span("value"), "secret", m["value"]) for m in ACCESS.finditer(text)]
    if "::" in text or text.count(":") > 6:
        found += [Entity(*m.span(), "ipv6", m[0].lower()) for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    if DIGIT.search(text):
        found += [Entity(*m.span(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text) if _iban_number(m[0].replace(" ", "")) % 97 == 1]
        for m in DIGITS.finditer(text):
            if m.end() - m.start() < 7:
                continue
            for kind, pattern in (("ip", IPV4), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
                # One more character, so that what follows is seen.
                for x in pattern.finditer(text, m.start(), min(len(text), m.end() + 1)):
                    plain = x[0] if kind == "ip" else re.sub(r"\D", "", x[0])
                    if kind != "card" or luhn(plain):
                        found.append(Entity(*x.span(), kind, plain))
    found += _names(text) if TITLE.search(text) else []
    found.sort(key=lambda e: e.start)
    out: list[Entity] = []
    rank = {k: i for i, k in enumerate(("email", "secret", "iban", "ip", "ipv6", "card", "ssn", "phone"))}
    for e in found:
        while out and e.start < out[-1].end and rank.get(e.kind, 9) < rank.get(out[-1].kind, 9):
            out.pop()
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _emails(text: str) -> list[Entity]:
    """From each @ outwards, so that a long run of letters is looked at once, whether an @ follows it or not."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at)
        if host:
            start = at
            while start > last and LOCAL.match(text[start - 1]):
                start -= 1
            # Names joined by single dots, as many as stand before the @.
            local = text[start:at].rpartition("..")[2].lstrip(".")
            if local and not local.endswith("."):
                out.append(Entity(at - len(local), host.end(), "email", text[at - len(local) : host.end()].lower()))
                last = host.end()
        at = text.find("@", max(at + 1, last))
    return out


def _is_ipv6(text: str) -> bool:
    try:
        return text.count(":") > 1 and any(c != ":" for c in text) and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _names(text: str) -> list[Entity]:
    """Names behind a title, first names then the surname; and all other mentions of them, which also start with a capital."""
    found, kinds = [], {}
    for m in NAME.finditer(text):
        words = []
        for w in re.finditer(WORD, m["name"]):
            if not w[0][0].isupper():
                break
            words.append(w)
        for i, w in enumerate(words):
            plain = w[0].casefold()
            role = "surname" if i == len(words) - 1 else "first"
            # A word that is a surname in one place and a first name in another is one entity of the document.
            kind = kinds.setdefault(plain, f"{role}-{_script(w[0])}")
            found.append(Entity(m.start("name") + w.start(), m.start("name") + w.end(), kind, plain, TITLES[m["title"]] if role == "first" else ""))
    if kinds:
        taken = {e.start for e in found}
        longest = max(map(len, kinds))
        for run in RUN.finditer(text):
            word = run[0]
            parts = [p.span() for p in PARTS.finditer(word)]
            behind = [*(a for a, _ in parts[1:]), len(word) + 1]
            i = 0
            while i < len(parts):
                start, end = parts[i][0], None
                if word[start].isupper():
                    # The longest name that begins here; it may be a part of a word, and end in a hyphen.
                    for j in range(i, len(parts)):
                        if parts[j][1] > start + longest:
                            break
                        ends = range(min(behind[j] - 1, start + longest), parts[j][1] - 1, -1)
                        end = next((e for e in ends if word[start:e].casefold() in kinds), end)
                if end is None:
                    i += 1
                    continue
                if run.start() + start not in taken:
                    plain = word[start:end].casefold()
                    found.append(Entity(run.start() + start, run.start() + end, kinds[plain], plain))
                while i < len(parts) and parts[i][0] < end:
                    i += 1
    return found


def _script(word: str) -> str:
    point = ord(word[0])
    return "cyrillic" if 0x400 <= point < 0x530 else "greek" if 0x370 <= point < 0x400 else "latin"


class Stream:
    """Numbers drawn from a keyed hash of what they are for."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.n, self.bits = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bits) < 8:
            self.bits += hmac.digest(self.key, self.parts + self.n.to_bytes(4, "big"), hashlib.blake2b)
            self.n += 1
        value, self.bits = int.from_bytes(self.bits[:8], "big"), self.bits[8:]
        return value % n


def _shaped(text: str, draw: Stream) -> str:
    """Each letter and digit replaced by one of its kind; hexadecimal texts stay so."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isalpha():
            x = "abcdef"[draw.below(6)] if hexadecimal else "abcdefghijklmnopqrstuvwxyz"[draw.below(26)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isalpha():
            letters = "".join(dict.fromkeys("".join(SYLLABLES[_script(c.lower())])))
            x = letters[draw.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, text: str, attempt: int = 0, gender: str = "") -> str:
    """The normalised replacement of a normalised entity."""
    draw = Stream(key, kind, text, str(attempt))
    if attempt >= LAST:
        return f"[{kind.partition('-')[0]} {draw.below(1 << 64):016x}{draw.below(1 << 64):016x}]"
    longer = "x" * max(0, attempt - WIDER)
    if kind == "email":
        name, _, host = text.rpartition("@")
        labels = host.split(".")
        return f"{_shaped(name + longer, draw)}@{'.'.join([_shaped(x, draw) for x in labels[:-1]] + labels[-1:])}"
    if kind == "ip":
        a, b = map(int, text.split(".")[:2])
        private = a in (10, 127) or (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32)
        if attempt > 2 * WIDER:
            head = [240 + draw.below(15), draw.below(256)]  # reserved addresses
        elif private and attempt > WIDER:
            head = [10, draw.below(256)]
        elif a == 10 or a == 127:
            head = [a, draw.below(256)]
        elif private and a != 172:
            head = [a, b]
        elif private:
            head = [a, 16 + draw.below(16)]
        else:
            first = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
            head = [first[draw.below(len(first))], draw.below(256)]
        return ".".join(map(str, [*head, draw.below(256), 1 + draw.below(254)]))
    if kind == "ipv6":
        groups = [f"{1 + draw.below(16 ** min(4, len(g) + len(longer)) - 1):x}" if g else "" for g in text.split(":")]
        return ":".join(groups) if _is_ipv6(":".join(groups)) else text
    if kind == "card":
        body = text[0] + "".join(str(draw.below(10)) for _ in text[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in text[4:])
        return f"{text[:2]}{98 - _iban_number(text[:2] + '00' + body) % 97:02d}{body}"
    if kind == "phone":
        keep = max(0, len(text) - 10)  # country code
        return text[:keep] + "".join(str(2 + draw.below(8)) if i in (0, 3) else str(draw.below(10)) for i in range(len(text) - keep))
    if kind == "ssn":
        area = 900 + draw.below(100) if attempt > 2 * WIDER else 1 + draw.below(665)  # from 900 on, none are issued
        return f"{area:03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "secret":
        return _shaped(text + longer, draw)
    role, _, script = kind.partition("-")
    if role == "first":
        gender = GENDER.get(text, gender)
        names = FIRST_NAMES[script, gender] if gender in ("m", "f") else FIRST_NAMES[script, "m"] + FIRST_NAMES[script, "f"]
        # Further attempts compound names, so that there are always enough.
        return "-".join(names[draw.below(len(names))] for _ in range(1 + attempt)).casefold()
    return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + attempt))


def dressed(original: str, kind: str, plain: str) -> str:
    """The replacement written in the format of the place: separators, and the capitals of a name."""
    if plain.startswith("["):
        return plain
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(plain)
        return "".join(next(left) if c.isalnum() else c for c in original)
    if kind.startswith(("first", "surname")):
        return plain.upper() if len(original) > 1 and original.isupper() else "-".join(x.capitalize() for x in plain.split("-"))
    return plain


Told = dict[tuple[str, str], tuple[int, str]]


def replaced(text: str, key: bytes, told: Told) -> tuple[str, list[Entity]]:
    """The text with every entity replaced, and the entities; ``told`` has attempt and gender of entities where they matter."""
    found = detect(text)
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], dressed(text[e.start : e.end], e.kind, surrogate(key, e.kind, e.text, *told.get((e.kind, e.text), ())))]
        at = e.end
    return "".join([*out, text[at:]]), found


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(row, *e) for row, text in zip(batch.column("row").to_pylist(), batch.column("text")) for e in {(e.kind, e.text, e.gender) for e in detect(text.as_py() or "")}]
        row, kind, entity, gender = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.string()), *(pa.array(x, pa.string()) for x in (kind, entity, gender))], names=["row", "kind", "entity", "gender"])


def _derived(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [surrogate(key, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt", "gender")))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "surrogate"])


def settled(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, gender, surrogate) for distinct (kind, entity): no two surrogates of a kind agree, none is an entity.

    ``gender`` is what most titles tell of a first name, m or f, and empty if they tell nothing or as much of either.
    """
    fields = "kind string, entity string, attempt int, gender string"
    votes = F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0))
    state = entities.groupBy("kind", "entity").agg(votes.alias("votes"))
    state = state.select("kind", "entity", F.lit(0).alias("attempt"), F.when(F.col("votes") > 0, "m").when(F.col("votes") < 0, "f").otherwise("").alias("gender"))
    while True:
        state = checkpointed(state.mapInArrow(lambda b: _derived(b, key), f"{fields}, surrogate string"))
        shared = state.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("least")).filter("n > 1")
        twice = state.join(shared, ["kind", "surrogate"]).filter("entity <> least").select("kind", "entity")
        real = state.join(state.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        again = checkpointed(twice.union(real).distinct())
        if again.isEmpty():
            return state
        again = again.withColumn("again", F.lit(1))
        state = state.join(again, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"), "gender")


RESULT = "row string, doc_id long, text string, n_entities long, entities array<struct<start:int,end:int,kind:string>>"


def _write(batches: Iterator[pa.RecordBatch], key: bytes, everywhere: Told) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        own = batch.column("told").to_pylist() if "told" in batch.schema.names else None
        texts, found = [], []
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            told = everywhere if own is None else {(x["kind"], x["entity"]): (x["attempt"], x["gender"]) for x in own[i] or ()}
            new, entities = (None, []) if text is None else replaced(text, key, told)
            texts.append(new)
            found.append([{"start": e.start, "end": e.end, "kind": e.kind.partition("-")[0]} for e in entities])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(map(len, found), pa.int64()), pa.array(found, spans)], names=["row", "doc_id", "text", "n_entities", "entities"]
        )


def pseudonymised(documents: DataFrame, key: bytes) -> DataFrame:
    """(row, doc_id, text, n_entities, entities) for every row: the text with surrogates, and the spans replaced.

    ``entities`` are (start, end, kind) in code points of the original text. A null text stays null, an empty one empty;
    repeated rows are replaced alike; without entities a text is unchanged. An empty table gives no rows. Whoever has
    ``key`` can derive the surrogates of a known entity again; without it they tell nothing of the original but its format.
    """
    docs = in_small_batches(documents).select(row_name("doc_id", "text").alias("row"), "doc_id", "text")
    mentions = docs.select("row", "text").mapInArrow(_entities, "row string, kind string, entity string, gender string")
    state = settled(mentions.select("kind", "entity", "gender"), key)
    later = state.filter("attempt > 0 or gender <> ''").select("kind", "entity", "attempt", "gender")
    if (count := later.count()) > BROADCAST_ROWS:
        of_row = mentions.select("row", "kind", "entity").distinct().join(later, ["kind", "entity"]).groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "attempt", "gender")).alias("told"))
        return docs.join(of_row, "row", "left").mapInArrow(lambda b: _write(b, key, {}), RESULT)
    everywhere = {(r["kind"], r["entity"]): (r["attempt"], r["gender"]) for r in later.collect()} if count else {}
    held = documents.sparkSession.sparkContext.broadcast(everywhere)
    return docs.mapInArrow(lambda b: _write(b, key, held.value), RESULT)
